"""Operators for preparing training text, their queries and their corpus pipeline."""
