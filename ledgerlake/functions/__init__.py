"""Scalar functions: display of numbers, canonical JSON text, and functions of whole payloads."""
