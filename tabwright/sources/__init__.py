"""Readers, writers and asset indexes."""
