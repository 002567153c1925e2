"""Lumora: metrics and logs as Spark DataFrames, queried through small PromQL and LogQL subsets."""
