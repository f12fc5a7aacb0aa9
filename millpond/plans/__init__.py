"""Registered queries. Each reads whole tables of a folder; most come with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from millpond.sources.tables import read_parquet

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def plan(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the inventory rows it shows."""

    def register(build: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query registered twice: {name}")

        @wraps(build)
        def in_utc(spark: SparkSession, folder: str) -> DataFrame:
            # Zone-less times are turned into instants and back; that needs one fixed zone.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, folder)

        PLANS[name] = in_utc
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return register


def load_all() -> None:
    from millpond.plans import (  # noqa: F401
        analysis, charts, conversations, filters, forms, gateway, joins, loading, scalars, searching, streams, upserts,
    )


__all__ = ["COVERS", "PLANS", "SQL", "load_all", "plan", "read_parquet"]
