"""Column expressions, fixed tables and distribution functions."""
