"""Ordered, keyed collections and training-data operators on Spark."""
