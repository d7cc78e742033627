"""Column expressions: the number rule and predicates."""
