"""Errors raised while pipelines are declared or images are read."""


class TileReadError(Exception):
    """A tile's pixels can't be read."""


class ImageReadError(Exception):
    """An image can't be read."""


class MissingPart(Exception):
    """A pipeline was built without a part it needs."""


class ConflictingParts(Exception):
    """A pipeline was given parts that exclude one another."""
