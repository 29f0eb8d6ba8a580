"""Registered queries: the operators run over the given tables, each beside its SQL."""

from . import acquisition, imagery, points, reconstruction  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
