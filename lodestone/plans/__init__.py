"""Composed plans: the search pipeline, the registered queries and their SQL."""
