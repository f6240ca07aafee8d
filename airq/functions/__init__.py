"""Column expressions and small DataFrame helpers the operators are made of."""
