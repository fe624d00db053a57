"""Readers and writers of measurement files."""
