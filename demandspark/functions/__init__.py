"""Column expressions shared by the operators; all built-in, none in Python per row."""
