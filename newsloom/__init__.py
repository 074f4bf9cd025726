"""Corpus analytics on Spark: declarative operators over articles, pages, labels and event logs."""
