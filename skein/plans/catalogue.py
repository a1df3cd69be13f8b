"""Every query of the library with its SQL equivalent."""

from __future__ import annotations

from skein.plans import analytics, graphs, platform, review, scopes, texts

FLAGSHIP = "timed_chains"
PARTS = (graphs, analytics, texts, platform, review, scopes)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.SQL.items()}
