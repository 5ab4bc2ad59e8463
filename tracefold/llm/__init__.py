"""Operators for preparing training text at scale: packing, duplicates, extraction, scoring."""
