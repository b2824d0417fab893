"""Column functions: text and statistics."""
