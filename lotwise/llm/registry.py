"""Registered queries of the subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

from lotwise.llm import oracles, queries

QUERIES = dict(queries.QUERIES)
ORACLES = dict(oracles.ORACLES)
