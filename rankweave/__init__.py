"""Spark-first engine for ranked leaderboards built from semi-structured text."""
