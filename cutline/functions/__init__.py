"""Column builders: text, numbers, dates, vectors and nested values."""
