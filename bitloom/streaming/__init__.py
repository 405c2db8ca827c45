"""Framing of byte streams into messages."""
