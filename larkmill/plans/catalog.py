"""All registered queries by name."""

from __future__ import annotations

from larkmill.plans import details, files, ingest, matching, relational, reports, search, services, streams, texts

FAMILIES = (matching, relational, texts, ingest, files, reports, services, streams, search, details)
QUERIES = {name: q for family in FAMILIES for name, q in family.R.queries.items()}
ORACLE_SQL = {name: sql for family in FAMILIES for name, sql in family.R.sql.items()}
