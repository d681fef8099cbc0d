"""A PySpark-native engine for catalogue analytics."""
