"""weftwork: declarative data task graphs whose rows are handled by Spark."""

__version__ = "0.1.0"
