"""Readers and writers: vault folders, JSONL sets, cards, digests, driver tables."""
