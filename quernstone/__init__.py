"""Spark analytics for labelled-sequence datasets."""
