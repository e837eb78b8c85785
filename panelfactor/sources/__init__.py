"""Readers of panels, positions and configurations, with integrity checks."""
