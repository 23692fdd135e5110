"""Relational, profiling, join, text and verification operators."""
