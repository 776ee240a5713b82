"""Market-data cleaning, marts, text signals, quality checks and serving queries as Spark jobs."""
