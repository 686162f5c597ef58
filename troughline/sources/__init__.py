"""Readers, writers and the shared staging folder."""
