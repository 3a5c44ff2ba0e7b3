"""Regulatory text and process-model analytics on Spark."""
