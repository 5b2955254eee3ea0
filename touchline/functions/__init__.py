"""Column expressions and fixed names."""
