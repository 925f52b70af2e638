"""Enrich, score, store and query short social posts with Spark, in batch and as streams."""
