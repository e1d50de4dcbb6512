"""The operators as queries over the plain tables, and their DuckDB SQL."""

from __future__ import annotations

from sondeframe.queries import calendars, details, joins, learning, levels, statistics

QUERIES = {**levels.QUERIES, **statistics.QUERIES, **calendars.QUERIES, **learning.QUERIES, **details.QUERIES, **joins.QUERIES}
ORACLE_SQL = {**levels.SQL, **statistics.SQL, **calendars.SQL, **learning.SQL, **details.SQL, **joins.SQL}
