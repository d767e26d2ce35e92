"""Structured Streaming: score arriving export files batch by batch."""
