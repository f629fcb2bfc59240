"""Exact, auditable questions over held data, as lazy Spark plans."""
