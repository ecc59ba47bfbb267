"""Structured Streaming extensions; the batch operators need none of them."""
