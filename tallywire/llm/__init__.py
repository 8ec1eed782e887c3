"""Training-data operators: deduplication, tokenising, packing, archives and fingerprints."""
