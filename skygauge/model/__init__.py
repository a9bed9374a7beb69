"""Rain models on Spark ML."""
