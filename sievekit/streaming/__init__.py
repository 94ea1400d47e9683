"""Structured Streaming operators (incremental near-duplicate removal)."""
