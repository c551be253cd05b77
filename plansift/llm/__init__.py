"""Operators of a training-data pipeline: dedup, search, filtering, scanning, extraction, mixing and packing.

Nothing outside this subpackage imports it.
"""
