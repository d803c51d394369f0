"""Column expressions: windows, indicators, metrics and statistics."""
