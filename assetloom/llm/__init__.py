"""Operators for preparing text corpora, and their queries."""
