"""linkspan: entity linkage, history and observability queries as plain Spark DataFrame jobs."""
