"""Filters, views, grouping, sparse extraction and bundles."""
