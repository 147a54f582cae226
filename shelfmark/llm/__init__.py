"""Training-data operators: filtering, near-duplicate search, decontamination, sharding, packing, scoring."""
