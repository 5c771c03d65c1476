"""Column expressions with array semantics: missing is NULL, comparisons never are."""
