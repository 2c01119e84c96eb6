"""Operators on pixel tables (band, line, sample, value), where NULL means no data."""
