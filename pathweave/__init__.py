"""Frequent collinear stretches of gene families, computed as Spark jobs."""
