"""Subtitle-corpus jobs and training-data operators as Spark DataFrame work."""
