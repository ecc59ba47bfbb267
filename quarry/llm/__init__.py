"""Operators for preparing training data; nothing else in quarry imports this subpackage."""
