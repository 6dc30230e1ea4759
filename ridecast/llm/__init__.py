"""Operators for preparing training text: joins, classifiers, packing, sharding, index and search.

Nothing outside this package imports it.
"""
