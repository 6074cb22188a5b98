"""Column functions: text, dates, codes, names, JSON."""
