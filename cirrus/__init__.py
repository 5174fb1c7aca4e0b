"""cirrus — tabular preparation, profiling, feature and model-evaluation
operators on Spark DataFrames."""

__version__ = "0.1.0"
