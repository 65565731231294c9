"""Local-business page analytics as Spark DataFrame jobs."""
