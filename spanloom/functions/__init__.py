"""Column expressions: scoring, geometry, vectors, strings."""
