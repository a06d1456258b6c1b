"""Readers, writers and canonical series."""
