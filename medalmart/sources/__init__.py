"""Readers, writers and the session."""
