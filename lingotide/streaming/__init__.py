"""Structured Streaming upkeep of progress and daily counts."""
