"""Product quantisation in exact integers.

Components become integers, vectors are cut into equal consecutive parts, and each part
is coded by the nearest of its codebook's entries. Distances come from a limb-split
product: integers are broken into limbs whose float64 products stay below 2^53, the
products are put together in int64, and the first smallest distance decides. So codes,
errors and codebooks are the same on every machine and for every split of the rows.

A round is one scan: each task sums its rows per entry, Spark adds the sums, and only
the codebooks (parts x entries x length, whatever the number of rows) pass through the
driver. Coded rows are written once; their error per label meets them through a
broadcast of the few labels that hold many rows and a join for the others, so a label
may hold any share of the rows.

Rows whose vector is null, empty, or holds null or non-finite components are dropped.
All other vectors must have one length, divisible by the number of parts, and
components that can be coded exactly; else the job stops with a message. Codebooks start
from the smallest keys (null keys last, ties by the vector); fewer rows than entries give
fewer entries. Null keys and labels are kept (null labels are one label), repeated rows
count one by one. An empty table has no codebooks and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.exact_gemm import exact_product, floor_scaled, limb_bits, limbs
from asofkit.llm.text import HEAVY, checkpointed, look_up
from asofkit.llm.vectors import usable

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4


class Codebooks:
    """int64 entries of shape (parts, entries, length), with what the nearest-entry search needs."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.bits = limb_bits(entries.shape[2])
        self.limbs = [limbs(e, self.bits) for e in entries]
        self.squares = (entries * entries).sum(axis=2)

    def nearest(self, x: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row of ``x`` (int64): the first nearest entry and its squared distance."""
        away = self.squares[part] - 2 * exact_product(limbs(x, self.bits), self.limbs[part], self.bits)
        code = away.argmin(axis=1)
        return code, away[np.arange(len(x)), code] + (x * x).sum(axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _parts(batch: pa.RecordBatch, vector: str, scale: int, parts: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The usable rows and their integers as (rows, parts, length)."""
    rows, values = usable(batch, vector)
    if not len(values):
        return rows, np.zeros((0, parts, 0), np.int64)
    if values.shape[1] % parts:
        raise ValueError(f"vectors of {values.shape[1]} components cannot be cut into {parts} equal parts")
    length = values.shape[1] // parts
    return rows, floor_scaled(values, scale, length).reshape(-1, parts, length)


def first_vectors(df: DataFrame, key: str, vector: str, count: int, scale: int = SCALE, parts: int = PARTS) -> np.ndarray:
    """Integer vectors of the ``count`` smallest keys; a task passes on no more than ``count`` rows."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ints = None, None
        for batch in batches:
            rows, x = _parts(batch, vector, scale, parts)
            if not len(x):
                continue
            own, x = rows.column(key), x.reshape(len(x), -1)
            if keys is not None and len(keys) == count and keys[-1].is_valid:  # sorted: the last is the largest
                near = pc.fill_null(pc.less_equal(own, keys[-1]), False)
                own, x = own.filter(near), x[near.to_numpy(zero_copy_only=False)]
            keys, ints = (own, x) if keys is None else (pa.concat_arrays([keys, own]), np.concatenate([ints, x]))
            rank = pc.rank(keys, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
            order = np.lexsort((*ints.T[::-1], rank))[:count]
            keys, ints = keys.take(pa.array(order)), ints[order]
        if keys is not None:
            yield pa.record_batch([keys, pa.array(list(ints), pa.list_(pa.int64()))], names=["k", "x"])

    kind = df.schema[key].dataType.simpleString()
    best = df.select(key, vector).mapInArrow(smallest, f"k {kind}, x array<bigint>").orderBy(F.col("k").asc_nulls_last(), "x").limit(count)
    return np.array([r["x"] for r in best.collect()], np.int64)


def refined(df: DataFrame, vector: str, books: Codebooks, scale: int = SCALE) -> Codebooks:
    """One round: all parts assigned, each used entry replaced by the floor of its mean."""
    parts, entries, length = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            _, x = _parts(batch, vector, scale, parts)
            for p in range(parts if len(x) else 0):
                code, _ = books.nearest(x[:, p], p)
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                total[p, used] += np.add.reduceat(x[order, p], first, axis=0)
                count[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(count)
        yield pa.record_batch([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    each = df.select(vector).mapInArrow(sums, "part int, entry int, n long, sums array<bigint>").select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
    out = books.entries.copy()
    wide = F.sum(F.col("s").cast("decimal(20,0)"))
    for r in each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), wide.alias("s")).collect():  # parts x entries x length rows at most
        out[r["part"], r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return Codebooks(out)


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks over all rows; None where no row is usable."""
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    first = first_vectors(df, key, vector, entries, scale, parts)
    if not len(first):
        return None
    books = Codebooks(first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = refined(df, vector, books, scale)
    return books


def encode(df: DataFrame, books: Codebooks | None, carry: list[str], vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Per usable row: the ``carry`` columns, ``code`` (two hex digits a part) and ``error`` (squared distances, summed)."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _parts(batch, vector, scale, books.entries.shape[0] if books else PARTS)
            if not len(x):
                continue
            found = [books.nearest(x[:, p], p) for p in range(x.shape[1])]
            text = np.stack([c for c, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            width = 2 * len(found)
            code = pa.array([text[i : i + width] for i in range(0, len(text), width)], pa.string())
            yield pa.record_batch([*(rows.column(i) for i in range(len(carry))), code, pa.array(sum(e for _, e in found))], names=[*(f"c{i}" for i in range(len(carry))), "code", "error"])

    chosen = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), F.col(vector).alias(vector))
    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    out = chosen.mapInArrow(codes, f"{kinds}, code string, error long")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "code", "error")


def with_label_error(coded: DataFrame, label: str = "label", heavy: int = HEAVY) -> DataFrame:
    """Adds ``label_error``, the error summed over the rows of one label (nulls together).

    ``coded`` is read three times.
    """
    sums = checkpointed(coded.groupBy(label).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    return look_up(coded, label, sums, "_n", heavy)


def code_table(df: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """Per usable row: key, code, error, label_error and codebooks_sha256."""
    books = fit(df, key, vector)
    coded = checkpointed(encode(df, books, [key, label], vector))
    digest = books.sha256() if books else hashlib.sha256(b"").hexdigest()
    return with_label_error(coded, label).select(key, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
