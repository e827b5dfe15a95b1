"""A Spark-native analytics engine for repeated-sampling evaluation data."""
