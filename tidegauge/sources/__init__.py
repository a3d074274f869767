"""Readers and domain tables."""
