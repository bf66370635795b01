"""Column expressions: text, vectors, tokens, rendering."""
