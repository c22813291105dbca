"""Operators that prepare text for training language models.  Nothing else in arcweave imports this package."""
