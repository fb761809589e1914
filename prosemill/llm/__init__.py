"""Training-data operators: scans, deduplication, search, packing, media, archives and tokenising.

Nothing else in the library imports this subpackage.
"""
