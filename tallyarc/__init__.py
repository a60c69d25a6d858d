"""Evidence analytics on Spark DataFrames: support, ties, intervals, graphs, sequences."""

__version__ = "0.1.0"
