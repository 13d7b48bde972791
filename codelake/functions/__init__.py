"""Column functions over source text."""
