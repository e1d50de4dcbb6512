"""Column expressions: physics and level-to-level numerics."""
