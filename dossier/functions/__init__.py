"""Column expressions: text cleaning, keys, tokenizers, redaction, bullet metadata."""
