"""Readers, writers and the test tables."""
