"""Every registered query, with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from duelframe.operators import endpoints, evaluation, features, form, inputs, learned, linking, market, matchup, metrics, models, preview, ranking, ratings, relational, search, skills, styles
from duelframe.plans import sql
from duelframe.sources import documents, records, sinks
from duelframe.streaming import state, windows

_MODULES = (metrics, form, features, endpoints, market, ratings, skills, ranking, evaluation, matchup, relational, documents, records, sinks, learned, models, inputs, preview, search, styles, linking, windows, state, sql)
QUERIES: dict = {}
ORACLES: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
