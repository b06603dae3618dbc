"""Column expressions: geometry, sequences and relational sketches."""
