"""Spark-first operators for surveys made of many overlapping, located captures and their event streams."""
