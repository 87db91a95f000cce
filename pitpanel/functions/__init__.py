"""Column expressions: dates, names, scores."""
