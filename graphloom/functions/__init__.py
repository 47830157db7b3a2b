"""Column functions: text, similarity, JSON."""
