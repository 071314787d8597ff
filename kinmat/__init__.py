"""Thresholded pairwise similarity of integer vectors, and its validation, on Spark."""
