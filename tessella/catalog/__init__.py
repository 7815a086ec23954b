"""All queries of the engine by name, with their SQL where SQL can express them.

Every query runs over the whole of its tables. The test tables hold no pictures, so
tessella.adapters shapes the logical tables out of them.
"""

from __future__ import annotations

from ..adapters import oracle
from . import changes, copies, people, reads, shown, stores

_PARTS = (stores, shown, changes, copies, people, reads)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL = {k: oracle(sql) for part in _PARTS for k, sql in part.SQL.items()}
