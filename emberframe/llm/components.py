"""Connected components of the links that operators find; the rounds are those of the library's graphs."""

from __future__ import annotations

from emberframe.operators.graphs import components

__all__ = ["components"]
