"""Structured Streaming over arriving sources."""
