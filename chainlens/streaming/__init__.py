"""Incremental verification with Structured Streaming."""
