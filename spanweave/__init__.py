"""Longitudinal person-timeline analytics as PySpark DataFrame jobs."""
