"""Threat and evidence analytics as Spark jobs."""
