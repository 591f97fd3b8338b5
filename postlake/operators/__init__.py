"""Relational operators: filters, joins, aggregates, windows, merges, resolution."""
