"""Readers and writers of raw records and tables."""
