"""Text counting, metric series, log mining, status and fleet reports as Spark jobs."""
