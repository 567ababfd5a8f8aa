"""Quernstone: a Spark-first analytics engine for source estates and text corpora."""
