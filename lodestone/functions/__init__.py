"""Column functions: units, numbers, pointers, closeness."""
