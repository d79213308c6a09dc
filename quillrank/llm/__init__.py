"""Training-data operators: deduplication, token files, fingerprints, search, classifiers, packing.

Nothing outside this package imports it.
"""
