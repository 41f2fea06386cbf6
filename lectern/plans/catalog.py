"""All queries of the core and their SQL."""

from __future__ import annotations

from lectern.plans import data_queries, search_queries

QUERIES = {**search_queries.QUERIES, **data_queries.QUERIES}
SQL = {**search_queries.SQL, **data_queries.SQL}
