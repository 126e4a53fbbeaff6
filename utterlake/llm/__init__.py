"""Operators for large text corpora: language, quality, duplicates, packing, search and tokens."""
