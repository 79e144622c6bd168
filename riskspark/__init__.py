"""Credit-risk tables on Spark: quality, features, models, thresholds, drift, logs."""
