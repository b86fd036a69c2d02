"""A filter of fixed size over 64-bit values, gathered in Spark; its size never follows the data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22


def places(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The filter place of each value (values spread over all 64 bits)."""
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def gather(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """One boolean per place: whether a value of ``column`` (signed 64 bits) falls on it.

    Comes to the driver as 2^(bits - 6) rows at most.
    """
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    word = df.select(place.alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b"))
    words = np.zeros(1 << (bits - 6), np.uint64)
    for r in word.groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toLocalIterator():
        words[r["w"]] = np.int64(r["b"]).astype(np.uint64)
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def split(df: DataFrame, column: str, listed: DataFrame, listed_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash may be listed, rows whose hash surely is not); only the first need a join.

    Hashes are signed 64-bit columns. The filter has 2^22 places however many are listed.
    """
    wanted = df.sparkSession.sparkContext.broadcast(gather(listed, listed_column))
    at = df.columns.index(column)

    def only(inside: bool):
        def run(batches):
            for batch in batches:
                hit = wanted.value[places(batch.column(at).to_numpy().view(np.uint64))]
                yield batch.filter(pa.array(hit if inside else ~hit))

        return df.mapInArrow(run, df.schema)

    return only(True), only(False)
