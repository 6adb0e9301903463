"""Operators for corpora of training text: cleaning, near-duplicates, mixing, sharding, packing and token files."""
