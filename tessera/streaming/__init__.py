"""Continuous loading of tables."""
