"""Risk-shock and transmission analytics as Spark jobs."""
