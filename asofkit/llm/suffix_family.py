"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if it lies in a string of ``SPAN`` (200) bytes that also starts anywhere
else, in the same text or another; matches never cross texts.

Suffixes are sampled so that equal strings are sampled alike: of the 101 suffixes
that start inside a string of 200 bytes and have 100 bytes left in it, the one whose
first 100 bytes have the smallest hash (the last of equals) stands for the string. A
sampled suffix thus stands for a run of neighbouring strings, its block. Suffixes are
ordered by the hash of their first 100 bytes, then by the hash of their block.

* Each part of the corpus is a batch; its suffixes, dealt to buckets by their first
  100 bytes, are sorted into suffix arrays.
* In a bucket every new array is merge-scanned against the levels there are: equal
  blocks are long matches, found at once; equal beginnings with different blocks are
  left open. Then it becomes a level, and levels of equal size class merge.
* Open blocks are compared string by string, dealt by the hash of each string. Their
  bytes are fetched from the texts of only those documents that have any, one copy of
  each distinct block.

Hashes have 64 bits; two blocks count as equal if both of their hashes agree. Null
texts count as empty; texts under 200 bytes keep all bytes. Equal rows are documents of
their own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm import bits
from asofkit.llm.text import checkpointed, map_rows, mixed, powers

SPAN, START = 200, 100
REACH = SPAN - START + 1
CHUNK = 1 << 18  # strings of one text sampled at a time
HELD = 300_000  # suffixes of one batch
BUCKET_BYTES = 16 << 20
VALUES = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
COMPARED = 400_000  # bytes of open blocks hashed at a time
PLACE = np.uint64((1 << 20) - 1)

SUFFIX = np.dtype([("key", "<u8"), ("block", "<u8"), ("row", "<i8"), ("first", "<i4"), ("more", "<i2"), ("found", "?"), ("open", "?")])


def running(a: np.ndarray) -> np.ndarray:
    """Running sums whose differences are polynomial hashes of the bytes between."""
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(VALUES[a] * powers(len(a))[0][: len(a)], out=out[1:])
    return out


def sampled(text: bytes, row: int) -> Iterator[np.ndarray]:
    """Sampled suffixes of a text with the strings each stands for: ``first`` to ``first + more``."""
    for base in range(0, len(text) - SPAN + 1, CHUNK):
        a = np.frombuffer(text, np.uint8, min(CHUNK + SPAN - 1, len(text) - base), base)
        c = running(a)
        back = powers(len(a) + 1)[1]
        n = len(a) - START + 1
        h = mixed((c[START:] - c[:-START]) * back[:n])
        low = (h & ~PLACE) | (PLACE - np.arange(n, dtype=np.uint64))
        width = 1
        while 2 * width <= REACH:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < REACH:
            low = np.minimum(low[: width - REACH], low[REACH - width :])
        at = (PLACE - (low & PLACE)).astype(np.int64)
        firsts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        lasts = np.r_[firsts[1:] - 1, len(at) - 1]
        at = at[firsts]
        e = np.zeros(len(firsts), SUFFIX)
        e["key"], e["row"], e["first"], e["more"] = h[at], row, firsts + base, lasts - firsts
        e["block"] = mixed((c[lasts + SPAN] - c[firsts]) * back[firsts] + mixed((at - firsts).astype(np.uint64) << np.uint64(32) | (lasts - firsts).astype(np.uint64)))
        yield e


def in_order(e: np.ndarray) -> np.ndarray:
    return e[np.lexsort((e["block"], e["key"]))]


def scan(new: np.ndarray, level: np.ndarray) -> None:
    """Marks, in both arrays, blocks that the other has too and beginnings that it has with another block."""
    for e, other in ((new, level), (level, new)):
        a, b = np.searchsorted(other["key"], e["key"]), np.searchsorted(other["key"], e["key"], "right")
        some = np.flatnonzero(a < b)
        a, b, own, blocks = a[some], b[some], e["block"][some], other["block"]
        e["open"][some] |= (blocks[a] != own) | (blocks[b - 1] != own)
        low, high = a, b
        while (low < high).any():  # each block's place in its run of equal beginnings
            middle = (low + high) // 2
            right = (low < high) & (blocks[np.minimum(middle, b - 1)] < own)
            low, high = np.where(right, middle + 1, low), np.where(right, high, np.maximum(low, middle))
        e["found"][some] |= (low < b) & (blocks[np.minimum(low, b - 1)] == own)


def scan_within(e: np.ndarray) -> None:
    """The same inside one sorted array."""
    if len(e) < 2:
        return
    same_key = e["key"][1:] == e["key"][:-1]
    same = same_key & (e["block"][1:] == e["block"][:-1])
    e["found"][1:] |= same
    e["found"][:-1] |= same
    starts = np.flatnonzero(np.r_[True, ~same_key])
    ends = np.r_[starts[1:], len(e)] - 1
    varied = e["block"][starts] != e["block"][ends]
    e["open"] |= np.repeat(varied, ends - starts + 1)


class Family:
    """Suffix arrays of geometrically growing sizes."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> None:
        batch = in_order(batch)
        scan_within(batch)
        for level in self.levels:
            scan(batch, level)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]).bit_length() <= len(self.levels[-1]).bit_length():
            self.levels.append(in_order(np.concatenate([self.levels.pop(), self.levels.pop()])))

    def whole(self) -> np.ndarray:
        return in_order(np.concatenate(self.levels)) if self.levels else np.zeros(0, SUFFIX)


def _batches(buckets: int):
    """Per batch and bucket one row: the suffixes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def pack() -> pa.RecordBatch:
            every = np.concatenate(held)
            where = (every["key"] >> np.uint64(24)) % np.uint64(buckets)
            turn = np.argsort(where, kind="stable")
            every, where = every[turn], where[turn]
            starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(where[starts].astype(np.int32)), pa.array([x.tobytes() for x in np.split(every, starts[1:])], pa.binary())], names=["bucket", "suffixes"])

        for batch in batches:
            for row, body in zip(batch.column(0), batch.column(1), strict=True):
                for e in sampled(body.as_py() or b"", row.as_py()):
                    held.append(e)
                    size += len(e)
                    if size >= HELD:
                        yield pack()
                        held, size = [], 0
        if held:
            yield pack()

    return run


MARKED = "row long, first int, last int, key long, block long, resolved boolean"


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Found blocks (resolved), and one copy of each distinct block whose beginning has several."""
    families: dict[int, Family] = {}
    for batch in batches:
        for b, e in zip(batch.column(0), batch.column(1), strict=True):
            families.setdefault(b.as_py(), Family()).add(np.frombuffer(e.as_buffer(), SUFFIX).copy())
    for bucket in list(families):
        e = families.pop(bucket).whole()
        lone = np.r_[True, (e["key"][1:] != e["key"][:-1]) | (e["block"][1:] != e["block"][:-1])]
        for part, resolved in ((e[e["found"]], True), (e[e["open"] & lone], False)):
            for at in range(0, len(part), 50_000):
                p = part[at : at + 50_000]
                columns = (p["row"], p["first"], p["first"] + p["more"], p["key"].view(np.int64), p["block"].view(np.int64))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in columns), pa.array(np.full(len(p), resolved))], names=["row", "first", "last", "key", "block", "resolved"])


STRING = np.dtype([("value", "<u8"), ("row", "<i8"), ("place", "<i4")])  # place -1: its rows are marked already
RANGE = np.dtype([("row", "<i8"), ("first", "<i4"), ("last", "<i4")])


def packed_strings(blocks: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Of open blocks (key, row, first, strings, bytes): one of each distinct string, and runs of those that occur twice here.

    However many blocks share a string, one of it is left to be compared with other chunks of blocks.
    """
    keys, rows, firsts, counts, bodies = zip(*blocks, strict=True)
    counts = np.array(counts)
    sizes = counts + SPAN - 1
    starts = np.cumsum(sizes) - sizes
    a = np.frombuffer(b"".join(bodies), np.uint8)
    c = running(a)
    own = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    s = starts[own] + at
    value = mixed(mixed((c[s + SPAN] - c[s]) * powers(len(a) + 1)[1][s]) ^ np.array(keys, np.int64).view(np.uint64)[own])
    row, place = np.array(rows, np.int64)[own], (np.array(firsts, np.int64)[own] + at).astype(np.int32)
    turn = np.argsort(value)
    inorder = value[turn]
    same = inorder[1:] == inorder[:-1]
    twice = np.zeros(len(value), bool)
    twice[turn[1:][same]] = twice[turn[:-1][same]] = True
    e = np.empty(len(value), STRING)
    e["value"], e["row"], e["place"] = value, row, np.where(twice, -1, place)
    return e[np.sort(turn[np.r_[True, ~same]])], joined(row[twice], place[twice], place[twice])


def joined(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ranges with neighbouring ranges of one row put together; they come in order."""
    if not len(row):
        return np.zeros(0, RANGE)
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (first[1:] != last[:-1] + 1)])
    e = np.empty(len(starts), RANGE)
    e["row"], e["first"], e["last"] = row[starts], first[starts], last[np.r_[starts[1:] - 1, len(row) - 1]]
    return e


def _strings(buckets: int):
    """Per chunk of open blocks: its strings by bucket of their hash, packed, and one row of ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def pack() -> pa.RecordBatch:
            every, ranges = packed_strings(held)
            where = (every["value"] >> np.uint64(24)) % np.uint64(buckets)
            turn = np.argsort(where, kind="stable")
            every, where = every[turn], where[turn]
            starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            numbers, parts = where[starts].astype(np.int32), [x.tobytes() for x in np.split(every, starts[1:])]
            arrays = (np.r_[numbers, numbers[:1]], [*parts, ranges.tobytes()], [*[False] * len(parts), True])
            return pa.RecordBatch.from_arrays([pa.array(arrays[0]), pa.array(arrays[1], pa.binary()), pa.array(arrays[2])], names=["bucket", "packed", "ranges"])

        for batch in batches:
            for block in zip(*batch.columns, strict=True):
                held.append(tuple(x.as_py() for x in block))
                size += len(held[-1][-1])
                if size > COMPARED:
                    yield pack()
                    held, size = [], 0
        if held:
            yield pack()

    return run


def _range_batches(e: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(e), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[at : at + 50_000][x])) for x in RANGE.names], names=list(RANGE.names))


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings that came from several chunks, and the ranges that came along."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for bucket, packed, ranges in zip(*batch.columns, strict=True):
            if ranges.as_py():
                yield from _range_batches(np.frombuffer(packed.as_buffer(), RANGE))
            else:
                held.setdefault(bucket.as_py(), []).append(np.frombuffer(packed.as_buffer(), STRING).copy())
    for bucket in list(held):
        e = np.concatenate(held.pop(bucket))
        e = e[np.argsort(e["value"], kind="stable")]
        same = e["value"][1:] == e["value"][:-1]
        hit = e[(np.r_[False, same] | np.r_[same, False]) & (e["place"] >= 0)]
        hit = hit[np.lexsort((hit["place"], hit["row"]))]
        yield from _range_batches(joined(hit["row"], hit["place"], hit["place"]))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _range_batches(joined(*(batch.column(i).to_numpy() for i in range(3))))


def repeated_ranges(source: DataFrame) -> DataFrame:
    """(row, first, last): the strings starting at first..last of a row are repeated. ``source``: row, body."""
    spark = source.sparkSession
    total = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    per_suffix = (REACH + 1) / 2
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / per_suffix * SUFFIX.itemsize / BUCKET_BYTES) + 1)
    long_enough = source.where(F.octet_length("body") >= SPAN)
    marked = checkpointed(long_enough.mapInArrow(_batches(4 * buckets), "bucket int, suffixes binary").repartition(buckets, "bucket").mapInArrow(_families, MARKED))
    undecided = marked.where("NOT resolved")
    by_row = undecided.groupBy("row").agg(F.collect_list(F.struct("key", "first", "last")).alias("blocks"))  # of one text
    near = bits.split(long_enough, "row", undecided, "row")[0].dropDuplicates(["row"])

    def fetch(row, body, blocks):
        for b in blocks:
            yield b["key"], row, b["first"], b["last"] - b["first"] + 1, body[b["first"] : b["last"] + SPAN]

    contexts = map_rows(near.join(by_row, "row").select("row", "body", "blocks"), fetch, "key long, row long, first int, strings int, bytes binary")
    n_strings = undecided.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_strings * STRING.itemsize / BUCKET_BYTES) + 1)
    strings = contexts.mapInArrow(_strings(4 * parts), "bucket int, packed binary, ranges boolean").repartition(parts, "bucket")
    compared = strings.mapInArrow(_matched, "row long, first int, last int").repartition("row").sortWithinPartitions("row", "first").mapInArrow(_joined, "row long, first int, last int")
    return checkpointed(marked.where("resolved").select("row", "first", "last").union(compared))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the remaining bytes."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    source = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key), F.xxhash64(text)).alias("row"), body.alias("body"))
    ranges = repeated_ranges(source.select("row", "body"))
    some, rest = bits.split(source, "row", ranges, "row")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def cut(k, body, found):
        digest, at, removed, spans, reach = hashlib.sha256(), 0, 0, 0, -1
        for r in sorted(found or [], key=lambda r: r["first"]):
            a, b = r["first"], r["last"] + SPAN
            if a > reach:  # apart from the run before
                digest.update(body[at:a])
                spans += 1
                removed += b - a
                reach = b
            elif b > reach:
                removed += b - reach
                reach = b
            at = max(at, reach)
        digest.update(body[at:])
        yield k, len(body), removed, spans, digest.hexdigest()

    per_row = ranges.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("found"))  # of one text
    cuts = map_rows(some.join(per_row, "row", "left").select("k", "body", "found"), cut, schema)
    none = F.lit(0).cast("long")
    return cuts.union(rest.select(F.col("k").alias(key), F.octet_length("body").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("body", 256).alias("kept_sha256")))
