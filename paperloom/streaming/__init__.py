"""Structured Streaming: feed arrival and user-state events."""
