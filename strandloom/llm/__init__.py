"""Operators for training data: near-duplicates, quota sampling, shared spans, splits, chunking, leakage, tokens, mixing, abuse."""
