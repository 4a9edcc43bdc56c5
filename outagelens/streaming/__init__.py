"""Structured Streaming form of the trailing outage features (extension; the reference has no streams)."""
