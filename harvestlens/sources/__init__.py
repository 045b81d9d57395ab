"""Readers that turn landed files into tables."""
