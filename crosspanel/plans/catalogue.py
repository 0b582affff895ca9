"""All registered queries of the panel engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crosspanel.plans import audit_queries, ledger_queries, panel_queries, rollup_queries, walk_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (panel_queries, ledger_queries, audit_queries, walk_queries, rollup_queries):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
