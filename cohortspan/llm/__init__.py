"""Operators for preparing training text: dedup, language, secrets, mixing, packing."""
