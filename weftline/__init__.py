"""Weftline: record fusion and data preparation as PySpark DataFrame transformations."""
