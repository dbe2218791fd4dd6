"""Readers that turn files, exports and services into records."""
