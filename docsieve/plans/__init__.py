"""Registered queries over the star-schema and corpus tables."""
