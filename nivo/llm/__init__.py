"""Operators for preparing training text: deduplication, scans, language, mixing, sharding, archives."""
