"""Training-data operators: quality, tokens, rules, archives, duplicates, leaks, language, mixing."""
