"""Text screening and corpus preparation as Spark DataFrame jobs."""
