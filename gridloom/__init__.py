"""Multidimensional planning cubes and corpus preparation on PySpark."""
