"""Operators for large training corpora: mixing, scans, de-duplication, search, sharding and packing."""
