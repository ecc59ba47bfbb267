"""Scalar and text functions."""
