"""Daily weather-station analytics as Spark DataFrame jobs."""
