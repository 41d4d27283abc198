"""Column expressions: text, metric names, question parts, vectors."""
