"""Logs and the reports over them."""
