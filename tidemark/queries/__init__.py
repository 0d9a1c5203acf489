"""A query for each operator, with the SQL that an independent engine must answer alike."""

from __future__ import annotations

from tidemark.queries import base

# importing a family registers its queries
from tidemark.queries import capture, domain, expressions, governance, metrics, operations, quality, relations, storage, streams  # noqa: F401, I001

QUERIES = base.QUERIES
ORACLES = base.ORACLES
