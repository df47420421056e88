"""Continuous detection with Structured Streaming."""
