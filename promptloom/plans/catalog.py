"""All registered queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from . import benchmarks, caches, control, gate, manifests, optimize, requests, rewriting, routes, signals_plans, streams, telemetry
from .registry import ORACLE, QUERIES, Query

MODULES = (requests, signals_plans, manifests, routes, rewriting, gate, caches, telemetry, benchmarks, control, streams, optimize)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
