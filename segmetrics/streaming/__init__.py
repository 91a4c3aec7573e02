"""Structured Streaming: incremental upkeep of the full-history block bulk status."""
