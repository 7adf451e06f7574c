"""Operators for training-data pipelines over sequences and texts. Nothing else in the package imports this."""
