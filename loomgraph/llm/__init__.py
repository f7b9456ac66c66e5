"""Training-data operators: search, scans, deduplication, mixing, classification, formatting.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
