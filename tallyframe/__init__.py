"""A Spark-native engine for tabular data preparation and applied econometrics."""
