"""Operators of a training-data pipeline: dedup, joins, classifiers, tokens, search, formatting."""
