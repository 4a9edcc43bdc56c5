"""Relational operators: aggregations, joins, windows, sampling, evaluation, alerts."""
