"""Spark-first engine for preparing and analysing two-speaker dialogue corpora."""
