"""Streaming forms of the append-only sources."""
