"""Operators for training data; no other part of the library imports this package."""
