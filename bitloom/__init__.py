"""Schema-described binary data on Spark: decode, encode and query wire formats as DataFrames."""

__version__ = "0.1.0"
