"""Representation-divergence analytics over whole corpora, on PySpark."""
