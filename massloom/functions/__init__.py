"""Column expressions: ions, peak arrays, similarity, hashing, text."""
