"""Operators for text that is to become training data; nothing else in the library imports this."""
