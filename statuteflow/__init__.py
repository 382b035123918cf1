"""Regulatory-change analytics as Spark DataFrame jobs."""
