"""Document and signal analytics as Spark jobs."""
