"""voltspan: a PySpark-native analytics engine for infrastructure data."""
