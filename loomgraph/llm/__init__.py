"""Training-data operators: tokenising, filtering, deduplicating and packing documents."""
