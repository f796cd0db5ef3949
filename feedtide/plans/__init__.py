"""Whole runs and the catalogue of named queries."""
