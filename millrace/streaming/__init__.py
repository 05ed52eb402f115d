"""Continuous forms of batch sources."""
