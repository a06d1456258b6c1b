"""Composed plans: reports and the registered query catalog."""
