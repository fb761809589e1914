"""Column expressions for text: tokens, sentences, readability, normalisation."""
