"""Operators over rows with ids: filters, aggregates, joins, groups, profiles, windows of rows, receipts, reduction."""
