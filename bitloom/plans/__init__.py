"""Queries over the engine."""
