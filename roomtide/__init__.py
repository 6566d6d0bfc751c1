"""Occupancy and indoor-climate analytics as PySpark DataFrame jobs."""
