"""termweave: keyword co-occurrence analytics over publication metadata, on Spark."""

__version__ = "0.1.0"
