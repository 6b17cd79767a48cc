"""Spark-first analytics engine for spatial, sensor, retrieval and text-corpus data."""
