"""Operators of training-data pipelines: mixing, language ID, deduplication, search, chat formatting, archives, packing, token files."""
