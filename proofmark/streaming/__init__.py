"""Structured Streaming twins: the keyed budget and incremental batch progress."""
