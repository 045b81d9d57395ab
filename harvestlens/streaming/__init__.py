"""Structured Streaming forms of the run fold and the audit log."""
