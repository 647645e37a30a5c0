"""Structured Streaming: arriving objects become chunks and catalog rows."""
