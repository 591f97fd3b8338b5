"""All demonstration queries of the reference operators, with their SQL."""

from __future__ import annotations

from postlake.plans import checks, domain, feeds, frames, hints, identity, more, queues, relational, state, text

PARTS = (relational, text, state, domain, feeds, queues, more, frames, identity, hints, checks)
QUERIES = {k: v for p in PARTS for k, v in p.R.queries.items()}
ORACLE_SQL = {k: v for p in PARTS for k, v in p.R.sql.items()}
