"""Credit-risk analytics on Spark: features, profiling, drift, evaluation, gates."""
