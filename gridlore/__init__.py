"""gridlore: PySpark-native analytics over gridded, multi-year embedding vectors."""

__version__ = "0.1.0"
