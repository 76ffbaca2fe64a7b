"""sparlance: a PySpark-native engine for multi-turn text-to-SQL analytics."""

__version__ = "0.1.0"
