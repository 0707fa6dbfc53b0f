"""Column expressions: text, features, vectors, graphs, responses."""
