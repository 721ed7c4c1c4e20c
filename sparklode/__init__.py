"""A PySpark-native engine for ranked text retrieval and text analytics."""
