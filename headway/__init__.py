"""Headway: scheduled-transit analytics as Spark jobs."""
