"""Column expressions: text rules, similarity, geometry, identity."""
