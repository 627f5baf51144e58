"""Scans, index queries, aggregates and maintenance over the ledger views."""
