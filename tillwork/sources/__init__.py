"""Readers, writers and incremental-load state."""
