"""Relational operators: ordered windows, joins, linkage, review, selection, reports and name matching."""
