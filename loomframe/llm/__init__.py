"""Operators for building training corpora: packing, archives, quality, deduplication, extraction, privacy, mixing."""
