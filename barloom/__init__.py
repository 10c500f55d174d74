"""Batch analytics over equity bar panels, as Spark jobs."""
