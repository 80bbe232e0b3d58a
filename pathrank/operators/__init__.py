"""Operators over graph tables; each returns a lazy DataFrame."""
