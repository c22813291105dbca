"""Arcweave: fact checking over knowledge graphs, written as Spark DataFrame plans."""
