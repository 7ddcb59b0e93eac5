"""Spark-first analytics for road junctions, timing plans, point records and event times."""
