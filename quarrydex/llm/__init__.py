"""Training-data operators: deduplication, filtering, extraction, mixing, sharding.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
