"""Declared shapes: what is loaded, from where, and which queries and charts are named."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Resource:
    """One entity of a source. ``key`` may name several columns."""

    name: str
    key: tuple[str, ...] = ()
    created_at: str | None = None
    updated_at: str | None = None


@dataclass(frozen=True)
class Connector:
    id: str
    name: str
    description: str
    resources: tuple[Resource, ...] = field(default_factory=tuple)

    def resource_names(self) -> list[str]:
        return [r.name for r in self.resources]


# Declared result types of a named query (fixed values) and what they are in Spark.
RESULT_TYPES = {
    "string": T.StringType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.TimestampNTZType(),
    "json": T.VariantType(),
}


@dataclass(frozen=True)
class QuerySpec:
    name: str
    query: str
    description: str = ""
    columns: tuple[tuple[str, str], ...] = ()
    sample: tuple[dict, ...] = ()

    def result_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, RESULT_TYPES[t]) for c, t in self.columns])


CHART_TYPES = ("line", "area", "bar", "pie")
# Types a report may name that are drawn as a bar chart (fixed values).
DRAWN_AS_BAR = ("donut", "radar", "scatter", "sparkline")


@dataclass(frozen=True)
class ChartSpec:
    type: str
    query: str
    key: str
    series: tuple[str, ...] = ()

    def kind(self) -> str:
        kind = self.type.lower()
        if kind in CHART_TYPES:
            return kind
        if kind in DRAWN_AS_BAR:
            return "bar"
        raise ValueError(f"unknown chart type: {self.type}")
