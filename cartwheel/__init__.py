"""Basket analytics on Spark: ingest, segment, featurise, recommend, evaluate."""
