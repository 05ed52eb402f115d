"""Flows of several steps."""
