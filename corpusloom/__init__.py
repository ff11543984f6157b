"""Document-corpus analytics as Spark DataFrame jobs."""
