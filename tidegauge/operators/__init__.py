"""Data-processing operators."""
