"""Declared models, composed plans and governance."""
