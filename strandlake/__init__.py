"""Exact positional queries over many long sequences, on Spark."""
