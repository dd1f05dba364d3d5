"""Nearest-neighbour search under SQL predicates, rank fusion and text search on Spark."""
