"""Readers, writers and registry checks."""
