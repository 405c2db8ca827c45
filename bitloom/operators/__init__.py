"""Decode and encode as operators over DataFrames."""
