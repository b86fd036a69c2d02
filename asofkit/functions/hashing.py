"""Deterministic pseudo-random numbers and keys from SHA-256, independent of partitioning and engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F



def _poisson_cdf() -> list[float]:
    """Distribution function of Poisson(1), as far as it still grows in double precision."""
    out, total, k = [], 0.0, 0
    while not out or total + math.exp(-1) / math.factorial(k) > total:
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
        k += 1
    return out


POISSON_CDF = _poisson_cdf()
_STEPS = len(POISSON_CDF)


def hash_number(*parts: Column | str) -> Column:
    """First 13 hex digits of sha256 over the parts joined with '|', as a long."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def hash_uniform(*parts: Column | str) -> Column:
    """Uniform number in [0, 1), bit-exact in any engine that has sha256."""
    return hash_number(*parts) / F.lit(float(16**13))


def poisson_one(u: Column) -> Column:
    """Poisson(1) draw by inverting its distribution function."""
    chain = F.when(u < POISSON_CDF[0], 0)
    for k, c in enumerate(POISSON_CDF[1:], start=1):
        chain = chain.when(u < c, k)
    return chain.otherwise(_STEPS)


def poisson_one_sql(u: str) -> str:
    cases = " ".join(f"WHEN {u} < CAST({c!r} AS DOUBLE) THEN {k}" for k, c in enumerate(POISSON_CDF))
    return f"CASE {cases} ELSE {_STEPS} END"


def hash_uniform_sql(text: str) -> str:
    return f"(CAST('0x' || substr(sha256({text}), 1, 13) AS BIGINT) / CAST({float(16**13)!r} AS DOUBLE))"


def secret_key(secret: str, col: Column | str, length: int) -> Column:
    """Pseudonymous key: leading hex digits of sha256(secret|id)."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(secret), F.col(col).cast("string") if isinstance(col, str) else col.cast("string")), 256), 1, length)


def content_number(*cols: str) -> Column:
    """Order-free content number of a set of rows: the exact sum of the rows' hash numbers.

    Each value is written as its length, a colon and its text, NULL as a minus sign, so no two rows are written alike.
    """
    text = lambda c: F.col(c).cast("string")
    parts = [F.when(text(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c))) for c in cols]
    return F.sum(hash_number(*parts).cast("decimal(38,0)"))


def content_sql(*expressions: str) -> str:
    """The same number of one row in SQL."""
    parts = [f"coalesce(length(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), '-')" for e in expressions]
    return "CAST('0x' || substr(sha256(" + " || '|' || ".join(parts) + "), 1, 13) AS BIGINT)"
