"""Incremental classification on Structured Streaming."""
