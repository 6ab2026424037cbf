"""Column functions: text in, numbers, scores, tags and strings out."""
