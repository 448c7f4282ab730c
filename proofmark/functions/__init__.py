"""Column functions: text, numbers, similarity, images."""
