"""Readers and writers for the files the pipeline exchanges."""
