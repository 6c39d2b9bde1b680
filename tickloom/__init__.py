"""tickloom: cross-sectional market research as Spark DataFrame jobs."""

__version__ = "0.1.0"
