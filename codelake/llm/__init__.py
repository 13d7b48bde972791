"""Training-data operators: deduplication, scoring, filtering, encoding and packing.

Nothing else in the library imports this subpackage.
"""
