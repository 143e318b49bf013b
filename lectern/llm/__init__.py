"""Operators for building training data: packing, dedup, quality, mixing, token counts, web records."""
