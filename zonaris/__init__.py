"""Spatial-planning analytics and training-data operators on Spark."""
