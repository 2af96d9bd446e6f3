"""Paired-comparison analytics on Spark: audited tables, rating fits, tournaments, graded forecasts."""
