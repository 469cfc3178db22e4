"""Training-data operators: deduplication, filtering, mixing, packing, search.

Nothing else in the library imports this subpackage; it may be deleted.
"""
