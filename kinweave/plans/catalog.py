"""Named queries and their SQL oracles."""

from __future__ import annotations

from .linkage import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
