"""Typed knowledge records on Spark: ledger, text and vector retrieval, recall."""
