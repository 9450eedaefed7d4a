"""Spark-first analytics over scholarly metadata and text corpora."""
