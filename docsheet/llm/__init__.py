"""Operators for large training-data pipelines. Nothing else in docsheet imports this package."""
