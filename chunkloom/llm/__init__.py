"""Operators for preparing training data: search, filtering, deduplication, sharding and mixing."""
