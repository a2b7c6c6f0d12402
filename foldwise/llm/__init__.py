"""Training-data operators: mixing, deduplication, scoring, extraction, sharding."""
