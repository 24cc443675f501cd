"""Whole plans built from the operators, and the query catalogue."""
