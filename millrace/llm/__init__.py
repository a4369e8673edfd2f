"""Operators for building training data: extraction, fingerprints, near-duplicate and
substring removal, quality, mixing, token counts, packing, WARC and vector search.
Nothing else in the library imports this subpackage."""
