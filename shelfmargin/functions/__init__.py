"""Column expressions: money, names, dates, ranges, labels, choices."""
