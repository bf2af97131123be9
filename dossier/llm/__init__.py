"""Corpus operators for training data: scans, deduplication, quality, counting, mixing and filters."""
