"""Preprocessing, scorers and attributions as Spark jobs."""
