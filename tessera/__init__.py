"""Document analytics, hybrid retrieval and answer checking on Spark."""
