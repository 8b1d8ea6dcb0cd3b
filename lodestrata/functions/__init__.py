"""Column functions: no Spark job, no Python worker."""
