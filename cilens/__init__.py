"""CI failure analytics as Spark DataFrame and SQL jobs."""
