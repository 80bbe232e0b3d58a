"""Column functions: names, vectors, dates."""
