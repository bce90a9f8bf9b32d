"""Queries and what they compose. The registry loads all modules in an order in which each finds what it needs, whichever is asked for first."""

from . import registry  # noqa: F401
