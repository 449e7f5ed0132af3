"""The reference operators' queries over the driver's tables, by name, with their DuckDB SQL."""

from __future__ import annotations

from tracklattice.queries import aggregates, flights, joins, ordered, policy, reconstruction, scalars, sources, streams, validation  # noqa: F401
from tracklattice.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
