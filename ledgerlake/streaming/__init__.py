"""Incremental maintenance of the ledger."""
