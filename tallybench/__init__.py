"""Benchmark analytics for labelled tables, written as Spark DataFrame plans."""
