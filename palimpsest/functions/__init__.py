"""Column builders: text, keys, vectors and ranking signals."""
