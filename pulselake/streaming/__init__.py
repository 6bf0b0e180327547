"""Structured Streaming over annotation streams."""
