"""Structured Streaming variants of incremental operators."""
