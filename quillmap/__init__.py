"""A Spark-native engine for point-level spatial evidence."""
