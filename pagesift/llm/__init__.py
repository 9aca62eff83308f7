"""Operators for building training corpora: dedup, filtering, decontamination, sharding, encoding, extraction."""
