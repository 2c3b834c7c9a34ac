"""All registered queries with their SQL."""

from __future__ import annotations

from parley.plans import analysis, dialogue

QUERIES = {**dialogue.QUERIES, **analysis.QUERIES}
ORACLE_SQL = {**dialogue.SQL, **analysis.SQL}
