"""Whole flows: preparation, training, search and scoring."""
