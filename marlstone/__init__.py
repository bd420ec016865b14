"""Marlstone: scoped analytical queries and record processing on PySpark DataFrames."""

__version__ = "0.1.0"
