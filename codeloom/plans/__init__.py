"""Adapters of the test tables and the named queries over them."""

from . import graphs, locating, more, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
