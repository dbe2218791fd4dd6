"""Operators on documents, vectors, ledgers and reports."""
