"""Operators of a training-data pipeline: quality, duplicates, leaks, secrets, archives."""
