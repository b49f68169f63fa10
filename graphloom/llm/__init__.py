"""Training-data operators: tokenisation, near-duplicates, filtering, packing, fingerprints.

Nothing outside this subpackage imports it.
"""
