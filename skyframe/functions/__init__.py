"""Column functions: closed forms over rows and arrays."""
