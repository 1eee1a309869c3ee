"""A PySpark-native engine for querying and reshaping tabular data."""
