"""Readers, writers and the adapter that yields the basket star schema."""
