"""Training-data operators: archives, sharding, deduplication, scoring, mixing, tokenising and vector search.

Nothing outside this subpackage imports it.
"""
