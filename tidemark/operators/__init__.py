"""Operators on events: tiles, windowed as-of features, freshness, skew, leakage, evidence."""
