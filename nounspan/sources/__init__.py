"""Readers and writers.  Every schema is declared, none is inferred."""
