"""Column expressions: they take and return columns and never shuffle."""
