"""Training-data operators: extraction, filtering, dedup, mixing, scoring.

Nothing outside this subpackage imports it.
"""
