"""Operators that prepare training data: scoring, extraction, de-duplication, filtering, mixing."""
