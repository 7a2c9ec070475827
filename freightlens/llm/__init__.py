"""Operators for training-data corpora: language, packing, mixing, deduplication,
search, chat formatting, URL rules, scoring and quality. Nothing outside imports it."""
