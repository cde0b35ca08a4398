"""Packed messages in Structured Streaming."""
