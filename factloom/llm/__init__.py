"""Training-data operators: language ID, licence scans, token counts, deduplication, packing, extraction, media."""
