"""lattica: knowledge-base analytics written as Spark DataFrame, SQL and Structured Streaming jobs."""
