"""A Spark-native engine for daily risk indices and for training-data text operators."""
