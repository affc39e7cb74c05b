"""Composed plans: the registered queries and the workflow."""
