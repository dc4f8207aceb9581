"""Prompt-corpus analytics as Spark jobs: every operator is a function over DataFrames or Columns."""
