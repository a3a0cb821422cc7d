"""Whole runs, and the queries over the driver's tables."""
