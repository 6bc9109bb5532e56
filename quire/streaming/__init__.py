"""Structured Streaming over landing folders and the run ledger."""
