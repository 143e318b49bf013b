"""Lectern: permission-aware retrieval and text analytics as PySpark DataFrames."""
