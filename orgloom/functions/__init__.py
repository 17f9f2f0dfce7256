"""Column expressions: every rule is a built-in Spark expression, no UDF."""
