"""Column expressions and fixed reference values."""
