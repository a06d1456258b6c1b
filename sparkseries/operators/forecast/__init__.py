"""Forecasting models (survey F1-F13)."""
