"""Training-data operators: licences, duplicates, URL rules, tokens, quality, mixing, extraction."""
