"""Customer-review analytics as Spark jobs."""
