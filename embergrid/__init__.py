"""Labelled-embedding analytics and training-data preparation on Spark."""
