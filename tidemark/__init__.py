"""Tidemark: curation of large time-ordered collections as PySpark jobs."""
