"""Track analytics as Spark jobs: transforms take and return DataFrames."""
