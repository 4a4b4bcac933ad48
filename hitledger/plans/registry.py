"""Queries of the package: name, Spark plan and the SQL that states the same result."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure
from .fixtures import Inputs, with_relations

Plan = Callable[[Inputs], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    plan: Plan
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return shape(self.plan(Inputs(spark, sf_dir)), self.columns)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cast = {
            "i": "CAST({0} AS BIGINT) AS {0}",
            "d": "round(CAST({0} AS DOUBLE) + 3.3e-10, 6) + 0.0 AS {0}",
            "s": "CAST({0} AS VARCHAR) AS {0}",
            "date": "CAST({0} AS DATE) AS {0}",
            "ts": "CAST({0} AS TIMESTAMP) AS {0}",
        }
        picks = ", ".join(cast[kind].format(name) for name, kind in self.columns)
        return with_relations(self.sql, f"SELECT {picks} FROM answer")


def shape(df: DataFrame, columns) -> DataFrame:
    """Pick the declared columns with their declared types.

    Doubles are rounded to six digits; the small shift keeps a value that ends
    in a five at the seventh digit from falling either way.
    """
    types = {"i": "bigint", "s": "string", "date": "date", "ts": "timestamp_ntz"}

    def one(name, kind):
        c = F.col(name)
        if kind == "d":
            return (F.round(c.cast("double") + F.lit(3.3e-10), 6) + F.lit(0.0)).alias(name)
        return c.cast(types[kind]).alias(name)

    return df.select(*[one(n, k) for n, k in columns])


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, columns: str, sql: str | None = None):
    """Register a plan. ``columns`` reads ``name`` or ``name:kind`` (i, d, s, date, ts)."""
    cols = tuple((c.split(":") + ["s"])[:2] for c in columns.split())

    def wrap(plan: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, tuple(ids.split()), plan, tuple((a, b) for a, b in cols), sql)
        return plan

    return wrap
