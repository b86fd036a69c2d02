"""Registered queries: a Spark plan, its output columns, and (where SQL can say it) the same question in SQL.

The output spec is one string, ``name:type`` separated by blanks. Types: l long, s string, b boolean,
d date as yyyy-MM-dd text, f double rounded to 6 digits, f2 / f4 ... double rounded to that many digits.
Both engines cast to the same spec, so the comparison is about values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tables:
    """Lazy access to the parquet tables of one folder."""

    spark: SparkSession
    path: str

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    rows: str
    spec: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def columns(self) -> list[tuple[str, str]]:
        return [tuple(part.split(":")) for part in self.spec.split()]

    def run(self, spark: SparkSession, path: str) -> DataFrame:
        df = self.plan(Tables(spark, path))
        return df.select(*[_spark_cast(n, t) for n, t in self.columns()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        select = ", ".join(_sql_cast(n, t) for n, t in self.columns())
        return f"SELECT {select} FROM ({self.sql.strip()}) AS result"


def _digits(t: str) -> int:
    return int(t[1:] or 6)


def _spark_cast(name: str, t: str):
    c = F.col(name)
    if t == "l":
        c = c.cast("long")
    elif t == "s":
        c = c.cast("string")
    elif t == "b":
        c = c.cast("boolean")
    elif t == "d":
        c = F.date_format(c.cast("date"), "yyyy-MM-dd")
    else:
        c = F.nullif(F.round(c.cast("double"), _digits(t)) + F.lit(0.0), F.lit(float("nan")))
    return c.alias(name)


def _sql_cast(name: str, t: str) -> str:
    col = f'"{name}"'
    if t == "d":
        return f"strftime(CAST({col} AS DATE), '%Y-%m-%d') AS {col}"
    if t in ("l", "s", "b"):
        return f"CAST({col} AS {dict(l='BIGINT', s='VARCHAR', b='BOOLEAN')[t]}) AS {col}"
    return f"round(CAST({col} AS DOUBLE), {_digits(t)}) + 0.0 AS {col}"


REGISTRY: dict[str, Query] = {}


def query(name: str, rows: str, spec: str, sql: str | None = None):
    """Register the decorated plan builder; ``rows`` lists the inventory ids it answers."""

    def add(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, rows, spec, plan, sql)
        return plan

    return add
