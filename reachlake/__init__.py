"""Travel-time, feed and network analytics as Spark DataFrame jobs."""
