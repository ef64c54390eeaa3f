"""Operators for large training-data pipelines (deduplication, filters,
packing, formats). Nothing else in the package imports this subpackage."""
