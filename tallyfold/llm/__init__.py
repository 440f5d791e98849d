"""Operators of a training-data pipeline: quality, near-copies, repeats, personal data, mixing, packing, and more.

Nothing else in the library imports this subpackage."""
