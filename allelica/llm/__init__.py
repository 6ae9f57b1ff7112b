"""Training-data operators: quality, deduplication, decontamination, mixing, scoring, encoding, sharding.

Nothing outside this package imports it.
"""
