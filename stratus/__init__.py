"""Preparation of environmental sensor data, and of training documents, on Spark."""
