"""Bootstrap replicates as vectors: rows are shuffled once, whatever the number of replicates.

A cluster's weights in all replicates are one vector, a pure function of (seed, cluster).
Rows are dealt once into ranges of (keys, falling score, tie), sorted, and written with their
vector, half a byte a weight; so vectors are never shuffled and each is made once. A first scan gives every range's
weighted totals and the totals of its first and last score; chained over the few ranges
they say what lies above each range, and which of its scores began in an earlier one, so a
score may hold any share of the rows. A second scan carries vectors of running sums
through each range in batches. Memory follows batch x replicates; the driver holds
ranges x replicates numbers.

Scores and outcomes must not be NULL. A NULL cluster is one cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from asofkit.functions.hashing import POISSON_CDF
from asofkit.session import cut_lineage

PER_DIGEST = 8  # draws of 32 bits out of one SHA-256
CHUNK = 4096  # rows whose weight vectors are held at once
MOST_RANGES = 2048
REMEMBERED = 50_000  # clusters whose vectors a worker keeps
#: Smallest draws of weight 1, 2, ... among the whole numbers below 2^32 (12 of them, so a weight takes four bits).
STEPS = np.array([math.ceil(c * 2.0**32) for c in POISSON_CDF if c * 2.0**32 <= 2**32 - 1], np.uint32)
_known: dict[tuple, np.ndarray] = {}


def draw_weights(clusters: Sequence[str | None], seed: int, n_boot: int) -> np.ndarray:
    """Poisson(1) weights of clusters (rows) in replicates 1..n_boot."""
    heads = [f"{seed}|{i}".encode() for i in range(-(-n_boot // PER_DIGEST))]
    tails = [b"" if c is None else f"|{c}".encode() for c in clusters]
    raw = b"".join([sha256(head + tail).digest() for tail in tails for head in heads])
    u = np.frombuffer(raw, ">u4").reshape(len(clusters), -1)[:, :n_boot].astype(np.uint32)
    weights = np.zeros(u.shape, np.uint8)
    for step in STEPS:
        weights += u >= step
    return weights


def weight_vector(cluster: str | None, seed: int, n_boot: int) -> np.ndarray:
    """Poisson(1) weights of a cluster in replicates 1..n_boot."""
    return weight_table([cluster], seed, n_boot)[0]


def weight_table(clusters: Sequence[str | None], seed: int, n_boot: int) -> np.ndarray:
    """``draw_weights`` through a store of the clusters that this worker met lately."""
    new = [c for c in clusters if (c, seed, n_boot) not in _known]
    if new:
        if len(_known) + len(new) > REMEMBERED:
            _known.clear()
            new = list(clusters)
        _known.update(zip([(c, seed, n_boot) for c in new], draw_weights(new, seed, n_boot), strict=True))
    return np.stack([_known[c, seed, n_boot] for c in clusters])


def weight_matrix(clusters: pa.Array, seed: int, n_boot: int) -> np.ndarray:
    """Weights, rows x replicates."""
    coded = clusters.dictionary_encode()
    names = [*coded.dictionary.to_pylist(), None]
    return weight_table(names, seed, n_boot)[coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)]


def _pack(weights: np.ndarray) -> pa.Array:
    """Rows of weights as binary values, two weights to a byte."""
    even = np.pad(weights, ((0, 0), (0, weights.shape[1] % 2)))
    packed = np.ascontiguousarray(even[:, ::2] | even[:, 1::2] << 4)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(packed)]).cast(pa.binary())


def _unpack(packed: pa.Array, n_boot: int) -> np.ndarray:
    width = -(-n_boot // 2)
    raw = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), width)
    return np.stack([raw & 15, raw >> 4], axis=2).reshape(len(packed), 2 * width)[:, :n_boot]


def deal(df: DataFrame, keys: Sequence[str], cluster: str, n_boot: int, seed: int, tie: str | None = None) -> DataFrame:
    """Rows as (keys, p, y, w, part): written once, sorted by keys, falling p and tie; ``part`` numbers the ranges in that order.

    Weights are drawn where the rows are written, so no scan draws them again.
    """
    n = min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.col(tie) if tie else F.monotonically_increasing_id()  # without a tie-break any order does
    rows = df.select(*keys, F.col("p").cast("double").alias("p"), order.alias("_tie"), F.col("y").cast("double").alias("y"), F.col(cluster).cast("string").alias("_cluster"))
    by = [*keys, F.col("p").desc(), "_tie"]
    sorted_rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_tie")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _pack(weight_matrix(b.columns[-1], seed, n_boot))], names=[*b.schema.names[:-1], "_w"])

    schema = StructType([*sorted_rows.schema.fields[:-1], StructField("_w", BinaryType())])
    return cut_lineage(sorted_rows.mapInArrow(draw, schema).withColumn("_part", F.spark_partition_id()))


def _chunks(batches: Iterator[pa.RecordBatch], n_keys: int, n_boot: int) -> Iterator[tuple]:
    """(part, key, p, y, weights) with one key each, CHUNK rows at most."""
    for whole in batches:
        names = [whole.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(max(0, whole.num_rows - 1), bool)
        for x in names:
            change |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), whole.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            for at in range(start, end, CHUNK):
                b = whole.slice(at, min(CHUNK, end - at))
                key = tuple(b.column(i)[0].as_py() for i in range(n_keys))
                p, y = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("p", "y"))
                w = _unpack(b.column(b.schema.get_field_index("_w")), n_boot)
                yield b.column(b.schema.get_field_index("_part"))[0].as_py(), key, p, y, w


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Places where a run of rows that agree in all columns begins."""
    change = np.zeros(len(columns[0]) - 1, bool)
    for x in columns:
        change |= x[1:] != x[:-1]
    return np.flatnonzero(np.r_[True, change])


def _added(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weights (small whole numbers) added up per run."""
    return np.add.reduceat(w, first, axis=0, dtype=np.int32)


def _runs(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores in their order, and the weights of events and of others by score: (2, scores, replicates)."""
    first = _starts(p)
    events = _added(w * (y == 1)[:, None], first)
    return p[first], np.stack([events, _added(w, first) - events]).astype(np.float64)


def _scan(dealt: DataFrame, keys: Sequence[str], fields: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]) -> list:
    """One result row per (range, key), each with vectors over the replicates."""
    kinds = ", ".join(f"k{i} {dealt.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    schema = ", ".join(x for x in ("part int", kinds, fields, "v array<array<double>>") if x)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in run(batches):
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(rows, schema).collect()


@dataclass
class Range:
    """A range's own totals and, once chained, what lies before it."""

    first: float
    last: float
    totals: np.ndarray  # events and others, each over the replicates
    first_totals: np.ndarray
    last_totals: np.ndarray
    points: np.ndarray  # sums of w (p - y)^2, w log loss, w p
    above: np.ndarray | None = None  # totals of all scores above the first one
    begun: np.ndarray | None = None  # totals of the first score in earlier ranges
    rows_before: np.ndarray | None = None  # weight of all rows in earlier ranges
    goes_on: bool = False  # whether the last score has rows in the next range


@dataclass
class Chain:
    """All ranges of one key in order."""

    ranges: dict[int, Range] = field(default_factory=dict)

    @property
    def totals(self) -> np.ndarray:
        return sum(r.totals for r in self.ranges.values())

    @property
    def points(self) -> np.ndarray:
        """Added without rounding on the way."""
        return np.array([[math.fsum(x) for x in zip(*rows, strict=True)] for rows in zip(*[r.points for r in self.ranges.values()], strict=True)])

    def link(self) -> None:
        above = begun = before = np.zeros_like(next(iter(self.ranges.values())).totals)
        previous = None
        for _, r in sorted(self.ranges.items()):
            if previous is not None:
                if previous.last == r.first:
                    previous.goes_on = True
                else:
                    above, begun = above + begun, np.zeros_like(above)
            r.above, r.begun, r.rows_before = above, begun, before.sum(axis=0)
            if r.first == r.last:
                begun = begun + r.totals
            else:
                above, begun = above + begun + r.totals - r.last_totals, r.last_totals
            before = before + r.totals
            previous = r


def chains(dealt: DataFrame, keys: Sequence[str], n_boot: int) -> dict[tuple, Chain]:
    """First scan: totals of every range, chained per key."""

    def run(batches):
        state = None

        def row():
            part, key, s = state
            return (part, *key, s.first, s.last, np.concatenate([s.totals, s.first_totals, s.last_totals, s.points]).astype(np.float64).tolist())

        for part, key, p, y, w in _chunks(batches, len(keys), n_boot):
            if state is not None and state[1] != key:
                yield row()
                state = None
            if state is None:
                zero = np.zeros((2, n_boot))
                state = (part, key, Range(p[0], p[0], zero, zero, zero, np.zeros((3, n_boot))))
            s = state[2]
            scores, sums = _runs(p, y, w)
            at = lambda score: sums[:, scores == score].sum(axis=1)  # noqa: B023, E731
            tail = at(p[-1])
            s.last_totals = s.last_totals + tail if s.last == p[-1] else tail
            s.last = p[-1]
            s.totals = s.totals + sums.sum(axis=1)
            s.first_totals = s.first_totals + at(s.first)
            order = np.lexsort((y, p))
            first = _starts(p[order], y[order])
            u, v = p[order][first], y[order][first]
            q = np.clip(u, 1e-15, 1 - 1e-15)
            s.points = s.points + np.stack([(u - v) ** 2, -(v * np.log(q) + (1 - v) * np.log(1 - q)), u]).astype(np.longdouble) @ _added(w[order], first).astype(np.longdouble)
        if state is not None:
            yield row()

    out: dict[tuple, Chain] = {}
    for r in _scan(dealt, keys, "first double, last double", run):
        v = np.array(r["v"])
        key = tuple(r[f"k{i}"] for i in range(len(keys)))
        out.setdefault(key, Chain()).ranges[r["part"]] = Range(r["first"], r["last"], v[:2], v[2:4], v[4:6], v[6:])
    for c in out.values():
        c.link()
    return out


def _groups(dealt: DataFrame, keys: Sequence[str], linked: dict[tuple, Chain], n_boot: int, start: Callable, rows: int) -> dict[tuple, np.ndarray]:
    """Second scan by score. ``start(key, range, totals)`` gives a function (scores, events, others, running events, running others) -> None and its result array."""
    sent = dealt.sparkSession.sparkContext.broadcast({k: (c.totals, {n: (r.above, r.begun, r.goes_on) for n, r in c.ranges.items()}) for k, c in linked.items()})  # ranges x replicates

    def run(batches):
        state = None

        def flush(scores, sums):
            running = np.cumsum(sums, axis=1) + state["above"][:, None]
            state["add"](scores, sums[0], sums[1], running[0], running[1])
            state["above"] = running[:, -1]

        def close():
            if not state["goes_on"]:
                flush(np.array([state["score"]]), state["open"][:, None])
            return (state["part"], *state["key"], state["out"].tolist())

        for part, key, p, y, w in _chunks(batches, len(keys), n_boot):
            if state is not None and state["key"] != key:
                yield close()
                state = None
            if state is None:
                totals, ranges = sent.value[key]
                above, begun, goes_on = ranges[part]
                add, out = start(above, totals)
                state = {"part": part, "key": key, "above": above, "open": begun, "score": p[0], "goes_on": goes_on, "add": add, "out": out}
            scores, sums = _runs(p, y, w)
            if scores[0] == state["score"]:
                sums[:, 0] += state["open"]
            else:
                scores, sums = np.r_[state["score"], scores], np.concatenate([state["open"][:, None], sums], axis=1)
            if len(scores) > 1:
                flush(scores[:-1], sums[:, :-1])
            state["open"], state["score"] = sums[:, -1], scores[-1]
        if state is not None:
            yield close()

    total: dict[tuple, np.ndarray] = {}
    for r in _scan(dealt, keys, "", run):
        key = tuple(r[f"k{i}"] for i in range(len(keys)))
        total[key] = total.get(key, np.zeros((rows, n_boot))) + np.array(r["v"])
    return total


def ranking(dealt: DataFrame, keys: Sequence[str], linked: dict[tuple, Chain], n_boot: int) -> dict[tuple, np.ndarray]:
    """Per key: concordance (ties half) and step-wise average precision over the replicates; NaN with one class."""

    def start(above, totals):
        out = np.zeros((2, n_boot))
        events, others = totals

        def add(scores, pos, neg, cum_pos, cum_neg):
            with np.errstate(divide="ignore", invalid="ignore"):
                out[0] += (pos * (others - cum_neg + neg / 2)).sum(axis=0)
                out[1] += np.where(pos > 0, pos / events * cum_pos / (cum_pos + cum_neg), 0).sum(axis=0)

        return add, out

    found = _groups(dealt, keys, linked, n_boot, start, 2)
    for k, v in found.items():
        events, others = linked[k].totals
        with np.errstate(divide="ignore", invalid="ignore"):
            v[0] = v[0] / (events * others)
        v[:, (events == 0) | (others == 0)] = np.nan
    return found


def first_reaching(dealt: DataFrame, keys: Sequence[str], linked: dict[tuple, Chain], targets: Sequence[float], n_boot: int) -> dict[tuple, np.ndarray]:
    """Per key: events and others at or above the highest score whose share of events reaches each target (rows 2i, 2i + 1); NaN without events."""

    def start(above, totals):
        out = np.zeros((2 * len(targets), n_boot))
        need = [np.where(totals[0] > 0, (t - 1e-12) * totals[0], np.inf) for t in targets]
        open_ = [above[0] < n for n in need]  # a higher score has not reached it

        def add(scores, pos, neg, cum_pos, cum_neg):
            for i, t in enumerate(targets):
                with np.errstate(divide="ignore", invalid="ignore"):
                    reached = cum_pos / totals[0] >= t - 1e-12
                hit = reached.any(axis=0) & open_[i]
                at = reached.argmax(axis=0)
                b = np.flatnonzero(hit)
                out[2 * i, b], out[2 * i + 1, b] = cum_pos[at[b], b], cum_neg[at[b], b]
                open_[i] = open_[i] & ~hit

        return add, out

    found = _groups(dealt, keys, linked, n_boot, start, 2 * len(targets))
    for k, v in found.items():
        v[:, linked[k].totals[0] == 0] = np.nan
    return found


def top_events(dealt: DataFrame, keys: Sequence[str], linked: dict[tuple, Chain], sizes: dict[tuple, np.ndarray], n_boot: int) -> dict[tuple, np.ndarray]:
    """Per key: events among the first ``sizes[key]`` copies by (falling p, tie) in each replicate."""
    sent = dealt.sparkSession.sparkContext.broadcast({k: (sizes[k], {n: r.rows_before for n, r in c.ranges.items()}) for k, c in linked.items()})  # ranges x replicates

    def run(batches):
        state = None
        for part, key, p, y, w in _chunks(batches, len(keys), n_boot):
            if state is not None and state[1] != key:
                yield (state[0], *state[1], [state[3].tolist()])
                state = None
            if state is None:
                k, before = sent.value[key]
                state = [part, key, k - before[part], np.zeros(n_boot)]
            left, whole = state[2], w.sum(axis=0, dtype=np.int64)
            state[3] += (w[y == 1]).sum(axis=0, dtype=np.int64) * (left >= whole)
            cut = np.flatnonzero((left > 0) & (left < whole))  # replicates that end within these rows
            if len(cut):
                own = w[:, cut].astype(np.float64)
                taken = np.clip(left[cut] - (np.cumsum(own, axis=0) - own), 0, own)
                state[3][cut] += taken[y == 1].sum(axis=0)
            state[2] = left - whole
        if state is not None:
            yield (state[0], *state[1], [state[3].tolist()])

    total: dict[tuple, np.ndarray] = {}
    for r in _scan(dealt, keys, "", run):
        key = tuple(r[f"k{i}"] for i in range(len(keys)))
        total[key] = total.get(key, np.zeros(n_boot)) + np.array(r["v"][0])
    return total


def weighted_sums(df: DataFrame, cluster: str, columns: Sequence[Column], n_boot: int, seed: int, terms: Callable[[list[np.ndarray], np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``terms(columns, weights)`` (terms x replicates), without any order: one scan, added by Spark.

    ``terms`` adds up over rows and weights, so rows of a batch that agree in all columns are put together first.
    """

    count = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(count)])
                order = np.lexsort(x)
                x = x[:, order]
                first = np.flatnonzero(np.r_[True, (x[:, 1:] != x[:, :-1]).any(axis=0)])
                w = np.add.reduceat(weight_matrix(b.column(0), seed, n_boot)[order], first, axis=0, dtype=np.float64)
                own = terms(list(x[:, first]), w)
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

    rows = df.select(F.col(cluster).cast("string").alias("_c"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    each = rows.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    found = {r["i"]: r["x"] for r in each.collect()}  # terms x replicates numbers
    return np.array([found[i] for i in range(len(found))]).reshape(-1, n_boot)
