"""Column expressions: casts, text, display formats."""
