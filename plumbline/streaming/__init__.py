"""Structured Streaming summaries."""
