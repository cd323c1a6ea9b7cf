"""Structured Streaming forms of the copy operators (restartable copies)."""
