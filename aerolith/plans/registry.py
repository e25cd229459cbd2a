"""All queries of this package and the SQL that they are held against."""

from __future__ import annotations

from aerolith.plans import encounters, serving, sources, storage, tracking

QUERIES = {**tracking.QUERIES, **encounters.QUERIES, **serving.QUERIES, **sources.QUERIES, **storage.QUERIES}
SQL = {**tracking.SQL, **encounters.SQL, **serving.SQL, **sources.SQL, **storage.SQL}
