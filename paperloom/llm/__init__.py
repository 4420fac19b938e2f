"""Operators for preparing training text, their queries and the brute-force checks' helpers."""
