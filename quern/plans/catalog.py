"""All registered queries of the library, with the SQL that states their results."""

from __future__ import annotations

from quern.plans import outcomes, pieces, scans, search, streams, telemetry, texts, trajectories, usage, writes  # noqa: F401
from quern.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
from quern.plans.search import bm25_search as flagship  # noqa: F401
