"""Column functions: scalar types, IEEE arithmetic, vectors, bits."""
