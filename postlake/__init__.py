"""Job-market analytics on Spark: sources, keys, matching, merging, delivery, metrics."""
