"""helixmill: a PySpark-native analytics engine for interval-, set- and sequence-shaped data."""

__version__ = "0.1.0"
