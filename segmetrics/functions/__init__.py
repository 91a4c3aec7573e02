"""Column expressions: measures and dimension labels with their guards."""
