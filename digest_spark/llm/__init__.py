"""Corpus preparation for language-model training: sharding, deduplication, scoring, tokens."""
