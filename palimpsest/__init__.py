"""Versioned key-value analytics on PySpark."""
