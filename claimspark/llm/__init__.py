"""Operators for preparing training data at scale. Nothing else in the library imports this package."""
