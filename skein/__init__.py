"""Skein: link analysis and corpus preparation as Spark jobs."""
