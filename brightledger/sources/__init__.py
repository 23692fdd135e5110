"""Readers, writers and file checks."""
