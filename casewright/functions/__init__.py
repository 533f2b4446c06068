"""Column expressions: one input row, one output row, no shuffle."""
