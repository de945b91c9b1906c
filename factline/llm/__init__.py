"""Operators that a training-data pipeline needs; nothing outside imports them."""
