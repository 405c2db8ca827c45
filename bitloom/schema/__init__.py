"""Schemas of binary formats: loading, checking and rewriting them. All of it runs on the driver."""

from .model import Schema, load

__all__ = ["Schema", "load"]
