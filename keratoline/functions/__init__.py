"""Column functions: dates, numbers read from text, keys and repair rules."""
