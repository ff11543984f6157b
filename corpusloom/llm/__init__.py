"""Training-data operators: quality, sharding, extraction, packing, mixing, near copies, scoring, filters."""
