"""Column builders and aggregate expressions."""
