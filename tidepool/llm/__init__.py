"""Training-data operators: deduplication, search, decontamination, packing, filters and sharding."""
