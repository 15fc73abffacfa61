"""A Spark-native warehouse, data-quality and training-data engine."""
