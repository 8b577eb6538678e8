"""Column expressions and small aggregation helpers shared by the operators."""
