"""Column expressions: text similarity and exact statistics."""
