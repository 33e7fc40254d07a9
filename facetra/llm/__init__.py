"""Training-data operators: quality, language, near-duplicates, contamination, packing, sharding, archives."""
