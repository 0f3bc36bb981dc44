"""quarrydex: search and analysis of code and text collections on Apache Spark."""

__version__ = "0.1.0"
