"""Latent-state analytics as Spark jobs."""
