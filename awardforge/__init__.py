"""Contract recompete analytics as Spark jobs: DataFrame, SQL and Structured Streaming code only."""
