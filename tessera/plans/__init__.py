"""Queries: the logical form, name resolution, compilation, costs and plan texts."""
