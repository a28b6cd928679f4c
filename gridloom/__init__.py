"""Power-grid inventory analytics as Spark DataFrame jobs."""
