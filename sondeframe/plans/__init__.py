"""Whole analyses as one lazy plan each."""
