"""Privacy and usefulness of shared tables, measured with Spark DataFrames."""

__version__ = "0.1.0"
