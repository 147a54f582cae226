"""Read side of the catalog: listings, look-ups and statistics."""
