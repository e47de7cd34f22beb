"""Lodestone: Spark-first analytics over scientific result archives and text corpora."""
