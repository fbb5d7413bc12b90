"""Training-data operators: deduplication, near-duplicates, token counts, classification, mixing,
search, packing and web archives. Nothing else in the library imports this subpackage."""
