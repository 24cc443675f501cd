"""Column expressions and the string-similarity kernels."""
