"""A Spark-native analytics engine for evidence-backed conditional graphs."""
