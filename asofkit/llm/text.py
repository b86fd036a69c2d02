"""Helpers for operators that read texts in Arrow batches, one text at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from asofkit.session import cut_lineage as checkpointed
from asofkit.session import shared_folder

__all__ = ["Memo", "WHITE", "checkpointed", "gram_hashes", "keep_rows", "look_up", "map_rows", "mixed", "powers", "shared_folder", "table", "word_hashes"]


class Memo(dict):
    """Remembers ``fn(key)``; emptied when full, so that a worker's memory stays bounded."""

    def __init__(self, fn: Callable, limit: int = 300_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


WHITE = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 20
_IN_WORD = np.array([b not in WHITE for b in range(256)])
LONG_WORD = 256  # bytes
_ONES = np.uint64(2**64 - 1)
_BASE = 0x9E3779B97F4A7C17
_NEXT_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64; kept for later texts."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            _POWERS[i] = np.cumprod(table)
    return _POWERS


def _hash_chunk(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = _IN_WORD[a]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    blocks = np.ndarray(len(a) + 1, "<u8", text + bytes(8), strides=(1,))  # the 8 bytes from each place on
    h = mixed(lengths.astype(np.uint64) * np.uint64(_BASE))
    at, short = 0, np.flatnonzero(lengths <= LONG_WORD)
    while len(short):
        left = np.minimum(lengths[short] - at, 8).astype(np.uint64) * np.uint64(8)
        h[short] = mixed(h[short] ^ (blocks[starts[short] + at] & (_ONES >> (np.uint64(64) - left))))
        at += 8
        short = short[lengths[short] > at]
    for i in np.flatnonzero(lengths > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(text[starts[i] : starts[i] + lengths[i]], seed=_BASE)
    return h


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a text (runs of bytes other than ASCII white space), in order.

    A word's bytes are taken in blocks of eight, and the hash is scrambled after each, for
    all words of a text at once; so words of up to eight bytes and of one length never have
    equal hashes, and others only by chance. Very long words go through a library hash. Long
    texts are taken in chunks that end between words.
    """
    if not text:
        return np.zeros(0, np.uint64)
    if len(text) <= CHUNK:
        return _hash_chunk(text)
    parts, at = [], 0
    while at < len(text):
        m = _NEXT_WHITE.search(text, min(len(text), at + CHUNK))
        end = m.start() if m else len(text)
        parts.append(_hash_chunk(text[at:end]))
        at = end
    return np.concatenate(parts)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k items (k or more items needed); equal runs have equal hashes in every text."""
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def map_rows(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str, rows_out: int = 4096) -> DataFrame:
    """``fn(*values)`` of each row yields result tuples.

    Values are taken from Arrow one row at a time, so memory follows the largest
    text and one Arrow batch, not the partition.
    """
    kinds = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        out: list[tuple] = []

        def pack() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                out.extend(fn(*(v.as_py() for v in values)))
                if len(out) >= rows_out:
                    yield pack()
                    out.clear()
        if out:
            yield pack()

    return df.mapInArrow(run, kinds)


def keep_rows(df: DataFrame, column: str, keep: Callable[[bytes | str | None], bool]) -> DataFrame:
    """The rows whose value of ``column`` passes, all columns as they are."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(keep(v.as_py())) for v in batch.column(at)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


HEAVY = 50_000


def look_up(rows: DataFrame, key: str, listed: DataFrame, count: str, heavy: int = HEAVY) -> DataFrame:
    """``rows`` with the columns of ``listed``, which has one row per value of ``key`` (null is a value); others get nulls.

    ``count`` says how many rows have the value. Values with at least 1/heavy of all counted rows, at
    most ``heavy`` values at any size, are broadcast; the others are joined, and none of them has many
    rows. So no value needs a task of its own. Both sides are read twice: write them first if they are dear.
    """
    total = listed.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    added = [c for c in listed.columns if c not in (key, count)]
    many = F.col(count) * heavy >= total
    side = lambda part, mark: part.select(F.col(key).alias("_of"), *added, F.lit(mark).alias("_heavy"))
    same = F.col(key).eqNullSafe(F.col("_of"))
    met = rows.join(F.broadcast(side(listed.where(many), True)), same, "left")
    rest = met.where("_heavy IS NULL").select(*rows.columns).join(side(listed.where(~many), False), same, "left")
    return met.where("_heavy").unionByName(rest).select(*rows.columns, *added)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
