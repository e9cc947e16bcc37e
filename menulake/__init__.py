"""Menu analytics on Spark: search, counters, quality, matching, extraction and state."""
