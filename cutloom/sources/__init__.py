"""Readers, writers and tables derived from the star schema."""
