"""Relational operators over images, tiles, regions and objects."""
