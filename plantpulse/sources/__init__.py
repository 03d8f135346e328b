"""Readers, writers and parsers of the Bronze / Silver / Gold tables."""
