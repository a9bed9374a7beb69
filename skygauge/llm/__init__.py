"""Training-data operators: extraction, filtering, privacy, deduplication, mixing, packing."""
