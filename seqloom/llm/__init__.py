"""Training-data operators: scoring, packing, filters, deduplication, decontamination, search, sharding, language."""
