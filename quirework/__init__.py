"""Document analytics on Spark: pages, regions, words and learned corrections as DataFrames."""

__version__ = "0.1.0"
