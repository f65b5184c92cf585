"""Column functions: ids, coercions, text protection, classification."""
