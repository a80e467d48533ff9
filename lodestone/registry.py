"""Name -> query, and name -> the equivalent DuckDB SQL."""

from __future__ import annotations

from lodestone.plans.oracles import ORACLES
from lodestone.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
