"""Pixel programs written in a shading language."""
