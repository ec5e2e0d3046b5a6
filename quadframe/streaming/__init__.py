"""Continuous loading of quads."""
