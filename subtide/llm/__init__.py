"""Training-data operators: quality, deduplication, mixing, packing, archives and language-model scores."""
