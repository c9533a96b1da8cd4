"""Operators for preparing training data: extraction, identification, packing, deduplication,
classification, scanning and fingerprints. Nothing else in the library imports this package."""
