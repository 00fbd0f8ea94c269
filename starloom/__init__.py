"""starloom: star-schema analytics, query scoring and corpus operators on PySpark."""

__version__ = "0.1.0"
