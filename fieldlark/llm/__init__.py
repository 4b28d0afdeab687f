"""Training-data operators: tokenising, formatting, filtering, deduplication and sharding of text corpora."""
