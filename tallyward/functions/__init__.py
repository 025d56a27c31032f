"""Column expressions: dates, recodes, predicates and rounding."""
