"""Operators for preparing training text: counting, encoding, scanning, deduplicating, filtering."""
