"""Column expressions: cleaning helpers, measures and display formats."""
