"""Readers of profile files and adapters of plain tables."""
