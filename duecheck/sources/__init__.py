"""Readers, writers and load checks."""
