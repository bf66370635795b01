"""Schema linking and text-to-SQL evaluation as Spark jobs."""
