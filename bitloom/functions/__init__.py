"""Expressions and native Column functions over binary values."""
