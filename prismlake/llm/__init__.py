"""Training-data operators: sharding, deduplication, similarity joins, language-model
scoring, mixing, binary output, page extraction, quality scoring and tokenisation.

Nothing outside this subpackage imports it.
"""
