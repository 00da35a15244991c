"""Operators for training-data corpora: near duplicates, sharding, tokens, classifiers, extraction."""
