"""Readers: dump files, page streams, tables."""
