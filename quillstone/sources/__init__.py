"""Readers of statement files and market feeds, and the write policies of the tables they land in."""
