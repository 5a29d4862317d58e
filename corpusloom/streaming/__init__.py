"""Structured Streaming operators for growing logs."""
