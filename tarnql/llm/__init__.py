"""Training-data operators: search, filtering, deduplication, mixing, tokenising."""
