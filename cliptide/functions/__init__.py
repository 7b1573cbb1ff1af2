"""Column expressions: vectors, arrays, text, times and answers."""
