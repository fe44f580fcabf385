"""planloom: project and process analytics, and table cleaning, on PySpark."""

__version__ = "0.1.0"
