"""Named plans: each takes (spark, sf_dir) and returns a DataFrame; most have
an equivalent DuckDB statement over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def plan(name: str, oracle: str | None = None):
    """Register a plan under ``name`` with its oracle statement (None when the
    operator has no SQL equivalent: the check is then on rows only)."""

    def deco(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"duplicate plan {name}")
        PLANS[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn

    return deco
