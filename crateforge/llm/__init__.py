"""Operators for the training-data problems p1 to p9. Nothing outside this package imports it."""
