"""DataFrame transforms, one module per group of operators."""
