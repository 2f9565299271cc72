"""Training-data operators: search, scans, deduplication, extraction, models, mixing and packing.

Nothing outside this subpackage imports it.
"""
