"""Column-level helpers: fixed values, text, numbers, vectors."""
