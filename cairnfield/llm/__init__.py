"""Operators for preparing training text: filters, deduplication, packing, conversations, counts."""
