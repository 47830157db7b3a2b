"""Incremental scoring of arriving prediction rows."""
