"""Training-data operators: text filters, fingerprints, near-duplicates, packing.

Nothing else in the library imports this subpackage; ``queries`` holds the registered
queries and their SQL.
"""
