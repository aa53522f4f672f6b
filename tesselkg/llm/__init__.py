"""Operators for text and vector training data; nothing else in the package imports them."""
