"""Column functions: geometry, text, arrays and statistics."""
