"""Song search and enrichment as Spark DataFrame, SQL and Structured Streaming jobs."""
