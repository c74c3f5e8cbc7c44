"""Operators over the pixel table."""
