"""loomline: a PySpark-native data-plane analytics engine."""

__version__ = "0.1.0"
