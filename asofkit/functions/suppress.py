"""Small-cell suppression: numeric columns become NULL with a ``suppressed`` flag; ``shown`` gives the text form."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def small(n: Column, min_cell: int) -> Column:
    return F.coalesce((n > 0) & (n < min_cell), F.lit(False))


def cell(n: Column, min_cell: int) -> Column:
    """0 and counts from ``min_cell`` stay, smaller ones are NULL."""
    return F.when(~small(n, min_cell), n)


def shown(n: Column, min_cell: int) -> Column:
    return F.when(small(n, min_cell), F.lit(f"<{min_cell}")).otherwise(n.cast("string"))


def any_small(cols: Sequence[str], min_cell: int) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | small(F.col(c), min_cell)
    return out


def suppress_together(df: DataFrame, counts: Sequence[str], derived: Sequence[str], min_cell: int) -> DataFrame:
    """Any small count hides ALL the counts of the row and every rate that would give them back."""
    flag = any_small(counts, min_cell)
    out = df.withColumn("suppressed", flag)
    for c in (*counts, *derived):
        out = out.withColumn(c, F.when(~F.col("suppressed"), F.col(c)))
    return out


def suppress_counts(df: DataFrame, groups: Mapping[str, Sequence[str]], min_cell: int) -> DataFrame:
    """Each small count is hidden together with the shares derived from it."""
    flags = {c: small(F.col(c), min_cell) for c in groups}
    values = {c: F.when(~f, F.col(c)) for c, f in flags.items()}
    for c, shares in groups.items():
        for s in shares:
            values[s] = F.when(~flags[c], F.col(s))
    return df.withColumns({**values, "suppressed": any_small(list(groups), min_cell)})


def keep_keys_only(df: DataFrame, keys: Sequence[str], counts: Sequence[str], min_cell: int) -> DataFrame:
    """A row with a small cell keeps only its keys."""
    flag = any_small(counts, min_cell)
    return df.select(*keys, flag.alias("suppressed"), *[F.when(~flag, F.col(c)).alias(c) for c in df.columns if c not in keys])


def count_columns(df: DataFrame, pattern: str) -> list[str]:
    """Count columns chosen by a name pattern."""
    return [c for c in df.columns if re.search(pattern, c)]
