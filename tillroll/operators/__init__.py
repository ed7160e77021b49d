"""Reusable relational operators: ranking, filters, joins, data quality."""
