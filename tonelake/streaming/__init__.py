"""Ordered per-stream state, in batch and in Structured Streaming."""
