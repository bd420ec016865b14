"""Operators for preparing training data: extraction, deduplication, filtering, tokens, shards."""
