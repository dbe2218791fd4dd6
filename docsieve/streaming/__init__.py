"""Triggers over changing folders, surveillance cycles, sealed micro-batches, event-time windows."""
