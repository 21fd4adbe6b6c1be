"""spanloom: search and analysis of annotated text corpora on Spark DataFrames."""

__version__ = "0.1.0"
