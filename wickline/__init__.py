"""Candle analytics and corpus preparation as DataFrame transformations."""
