"""Operators of a training-data pipeline; ``catalog`` registers one query for each."""
