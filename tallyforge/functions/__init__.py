"""Column-level building blocks: coercion, predicates, dates, whole-frame checks."""
