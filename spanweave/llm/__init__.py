"""Training-data operators: mixing, fingerprints, packing, sharding, classifiers, near-dedup, rules, extraction, URL lists.

Nothing else in the package imports this subpackage.
"""
