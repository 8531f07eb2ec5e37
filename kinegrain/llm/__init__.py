"""Training-data operators: one module per operator, plus their queries and SQL."""
