"""Metagenome binning and corpus preparation as Spark jobs."""
