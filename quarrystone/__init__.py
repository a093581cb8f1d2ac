"""Spark-native governed analytics engine: semantic layer, medallion promotion, ingest, governance."""

__version__ = "0.1.0"
