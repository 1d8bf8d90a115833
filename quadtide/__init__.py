"""Quadtide: a Spark-first analytics engine for tiled imagery, its access logs and its catalogue."""
