"""Lineage analysis of single-cell copy-number data on Spark: segmentation, minimal-event distances, lineage trees, and tests of which
copy-number changes go with the expansion of a lineage."""
