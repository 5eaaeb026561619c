"""Column expressions: metrics, classifications and display text."""
