"""Structured Streaming: signal messages, file watching, daily bars from ticks."""
