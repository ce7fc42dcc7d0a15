"""Structured Streaming jobs for logs and activity."""
