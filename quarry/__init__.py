"""A PySpark-native retrieval and knowledge-base engine."""
