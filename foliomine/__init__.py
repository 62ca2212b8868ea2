"""Document catalog and extraction jobs built on Spark DataFrames."""

__version__ = "0.1.0"
