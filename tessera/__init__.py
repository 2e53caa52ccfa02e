"""tessera: a PySpark-native engine for semi-structured data."""
