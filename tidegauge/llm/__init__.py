"""Operators for large identifier sets and text corpora.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
