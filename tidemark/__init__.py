"""tidemark: point-in-time analytics over daily series and JSON payloads, on PySpark."""

__version__ = "0.1.0"
