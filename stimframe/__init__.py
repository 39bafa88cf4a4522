"""stimframe: a PySpark-native analytics engine for time-aligned feature data."""

__version__ = "0.1.0"
