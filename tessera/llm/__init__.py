"""Training-data operators: filtering, deduplication, mixing, search, extraction, tokenization.

Nothing outside this subpackage imports it.
"""
