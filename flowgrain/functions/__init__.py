"""Column expressions: link functions, conversions, error metrics."""
