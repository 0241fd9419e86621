"""Column functions over text, paths and queries."""
