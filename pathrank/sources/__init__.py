"""Graphs kept as tables: catalogue, scans and stored results."""
