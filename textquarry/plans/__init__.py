"""Whole plans: the corpus view, the ten-step pipeline, configuration, reports."""
