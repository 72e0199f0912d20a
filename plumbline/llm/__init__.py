"""Operators for training data: cleaning, deduplication, mixing and token files."""
