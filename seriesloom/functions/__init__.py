"""Column expressions and aggregates: identity, predicates, delta coding, measurements."""
