"""All queries of the engine outside the training-data operators, with their SQL."""

from __future__ import annotations

from corpusmill.operators import aggregates, coverage, evaluation, files, ingest, joins, lifecycle, mutations, names, normalise, planning, relational, reports, retrieval, scalars, selection, series, signals, text, usage, windows
from corpusmill.streaming import stateful, streams

from . import registry

#: Modules whose import enters their queries.
MODULES = (relational, joins, aggregates, windows, text, ingest, scalars, names, normalise, retrieval, selection, signals, coverage, usage, series, evaluation, lifecycle, mutations, reports, planning, files, streams, stateful)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
