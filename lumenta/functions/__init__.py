"""Column expressions on vectors and values."""
