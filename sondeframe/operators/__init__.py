"""Operators on profile, level, feature and assignment tables."""
