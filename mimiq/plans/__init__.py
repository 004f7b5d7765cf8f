"""Named queries that bind operators to the supplied tables."""
from . import library  # noqa: F401
