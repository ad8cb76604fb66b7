"""Model training jobs (survey §2.10) on Spark ML."""
