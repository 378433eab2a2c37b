"""Structured Streaming form of the landing step."""
