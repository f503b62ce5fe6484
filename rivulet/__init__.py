"""Rivulet: feed analytics and corpus preparation as PySpark DataFrame operations."""
