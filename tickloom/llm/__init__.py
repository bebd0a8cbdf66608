"""Operators for preparing training text: deduplication, filtering, formatting, mixing and tokenising."""
