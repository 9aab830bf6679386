"""Property-graph pattern queries and graph-data quality operators on Spark DataFrames."""

__version__ = "0.1.0"
