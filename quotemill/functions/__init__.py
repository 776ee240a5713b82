"""Column rules: null words, numbers, dates, texts."""
