"""Readers of landed files and the table store."""
