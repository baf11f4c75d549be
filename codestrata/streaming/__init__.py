"""Structured Streaming forms of the state queries."""
