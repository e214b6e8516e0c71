"""Scans: delimited corpora and run files."""
