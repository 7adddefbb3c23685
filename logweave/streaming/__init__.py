"""Structured Streaming: indexing with resume, and in-order release of chunks."""
