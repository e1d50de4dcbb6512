"""Structured Streaming over profile files."""
