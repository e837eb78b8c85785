"""Panels that arrive as streams."""
