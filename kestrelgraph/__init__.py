"""Attributed fact-graph and usage analytics as PySpark DataFrame programs."""
