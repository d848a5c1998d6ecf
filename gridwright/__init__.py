"""Tensor-operator semantics as PySpark DataFrame operations."""
