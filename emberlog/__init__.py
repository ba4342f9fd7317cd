"""A Spark engine for log-anomaly analytics and training-data preparation."""
