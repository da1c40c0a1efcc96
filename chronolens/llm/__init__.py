"""Training-data operators: sharding, packing, search, tokenizing, filtering and deduplication."""
