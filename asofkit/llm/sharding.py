"""Jump consistent hashing: a stable key and the shard count decide the shard, without a ring table.

Going from n to n + 1 shards moves about 1 / (n + 1) of the keys, all into the new
shard. Slots number the rows of a shard without gaps: rows fall into (shard, bucket)
cells, cells are counted, running totals of the few cells give each cell's first
slot, and rows are numbered inside their cell. Rows that agree in key, size and
checksum are counted together first, so that a key with many repeated rows is no
large group.

A null text has no bytes (size 1). Null keys share one shard. Repeated rows each get
their own slot. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The published jump consistent hash of 64-bit keys, for all keys at once."""
    key, last, j = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    active = np.ones(len(keys), bool)
    while active.any():
        last[active] = j[active]
        key[active] = key[active] * np.uint64(2862933555777941757) + np.uint64(1)
        j[active] = ((last[active] + 1) * ((1 << 31) / ((key[active] >> np.uint64(33)) + np.uint64(1)).astype(float))).astype(np.int64)
        active = j < shards
    return last.astype(np.int32)


def shard_of(key_hash, shards: int):
    """Column: the shard of a 64-bit key hash."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64, na_value=0).view(np.uint64), shards))

    return of(key_hash)


def assign_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot and grown_shard (the shard among one more)."""
    if shards < 1:
        raise ValueError("one shard at least")
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).cast("long").alias("crc"))
    same = rows.groupBy("k", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    h = F.xxhash64("k")
    cells = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = same.withColumn("shard", shard_of(h, shards)).withColumn("grown", shard_of(h, shards + 1)).withColumn("cell", F.pmod(F.xxhash64("k", "size", "crc"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # shards x cells rows
    first = placed.groupBy("shard", "cell").agg(F.sum("n").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy("k", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(first, ["shard", "cell"])
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK)))
    each = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1))
    return (
        numbered.withColumn("chunk", chunk)
        .withColumn("i", each)
        .select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at") + F.col("i")).cast("long").alias("slot"), F.col("grown").alias("grown_shard"))
    )
