"""Operators over the canonical long layout."""
