"""Sparse-vector retrieval and batch analytics expressed as Spark plans."""
