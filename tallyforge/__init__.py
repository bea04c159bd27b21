"""Ledger matching and data preparation as Spark DataFrame operators."""
