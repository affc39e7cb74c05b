"""Readers of landed files, rule tables and labels, and event views over the star-schema tables."""
