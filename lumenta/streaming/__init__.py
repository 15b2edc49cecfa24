"""Vectors that arrive as a stream."""
