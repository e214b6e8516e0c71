"""Column functions: text cleaning, tokens, n-grams, prompts and replies."""
