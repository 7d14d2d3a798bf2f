"""Registered queries, stages and their order."""
