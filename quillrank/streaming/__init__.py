"""Structured Streaming: an incremental citation index, beyond what the original system has."""
