"""Linkwell: approximate matching of name records with Spark, and operators for training-data pipelines."""
