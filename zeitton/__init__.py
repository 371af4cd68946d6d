"""News sentiment time series as Spark DataFrame jobs."""
