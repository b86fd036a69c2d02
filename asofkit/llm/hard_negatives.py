"""Hard negatives from a multi-index of two half-spaces.

Two codebooks, one per half of a vector, form cells; each row lies in the cell of its
nearest entry in either half. For a query, an entry's half-score bound is its inner
product with the query's half plus that half's length times the entry's radius (the
largest distance of its rows). A heap visits cells in the order of the two bounds' sum,
which no row of the cell can exceed, and a search ends when the next bound is below
everything still wanted: the last place of a full list, or the lower end of a window.
So answers are certified; they do not depend on the codebooks, which are fitted on a
bounded sample and only decide how many cells are visited. Scores are exact integers.

Shape of the job: rows are dealt to groups of bounded size by their number in the scan
(a hot id, label or vector cannot fill one), queries go to every group, and a task reads
a group's rows, indexes them, and streams the queries past them. Each group passes on its
certified best few per query; a window per query merges them. First the positives (rows
of the query's label, which lie together inside a cell), then, with their scores known,
the negatives. Nothing passes through the driver but the sample.

Rows with a null label, a null or empty vector, or any null or non-finite component take
no part. Null ids take part after all others and are never queries. Equal rows count one
by one; a query is not its own positive, an equal row is. Query rows that repeat are
searched once and give their results as often as they occur. Vectors have one length.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.exact_gemm import exact_product, floor_scaled, limb_bits, limbs
from asofkit.llm.text import checkpointed
from asofkit.llm.vectors import usable

SCALE = 256
SAMPLE = 2048  # rows at most that the codebooks are fitted on
ENTRIES = 8  # entries of each half's codebook
GROUP = 1 << 17  # rows a task holds at once
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


def _away(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Distances of all rows to all entries."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ entries.T + (entries * entries).sum(1), 0))


def fit_halves(sample: np.ndarray, entries: int = ENTRIES, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A codebook per half: means of the sample's nearest rows, a few rounds."""
    books = []
    for half in _halves(sample.astype(float)):
        book = half[np.linspace(0, len(half) - 1, min(entries, len(half))).astype(int)].copy()
        for _ in range(rounds):
            code = _away(half, book).argmin(1)
            for i in np.unique(code):
                book[i] = half[code == i].mean(0)
        books.append(book)
    return books[0], books[1]


class MultiIndex:
    """The rows of one group by cell, and inside a cell by label."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, null_id: np.ndarray, labels: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        self.books, self.width = books, len(books[1])
        codes, self.radii = [], []
        for half, book in zip(_halves(x.astype(float)), books, strict=True):
            away = _away(half, book)
            code = away.argmin(1)
            radius = np.full(len(book), -np.inf)  # an entry without rows bounds nothing
            np.maximum.at(radius, code, np.sqrt(((half - book[code]) ** 2).sum(1)))
            codes.append(code)
            self.radii.append(radius)
        cell = codes[0] * self.width + codes[1]
        order = np.lexsort((labels, cell))
        self.bits = limb_bits(x.shape[1])
        self.rows = limbs(x[order], self.bits)
        self.ids, self.null_id, self.labels = ids[order], null_id[order], labels[order]
        self.starts = np.searchsorted(cell[order], np.arange(len(books[0]) * self.width + 1)).tolist()

    def bounds(self, queries: np.ndarray) -> list[np.ndarray]:
        """Half-score bounds (queries x entries) of both halves, rounded up beyond the error of floating point."""
        out = []
        for q, book, radius in zip(_halves(queries.astype(float)), self.books, self.radii, strict=True):
            size = np.sqrt((q * q).sum(1))[:, None]
            reach = np.where(np.isfinite(radius), radius, 0)
            error = 1 + 1e-9 * size * (np.sqrt((book * book).sum(1)) + reach)
            out.append(np.where(np.isfinite(radius), q @ book.T + size * reach + error, -np.inf))
        return out

    def cells(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, start, end) of the cells that hold rows, by falling sum of the half bounds."""
        rank1, rank2 = np.argsort(-first), np.argsort(-second)
        a, b = first[rank1].tolist(), second[rank2].tolist()
        rank1, rank2 = (rank1 * self.width).tolist(), rank2.tolist()
        starts, heap = self.starts, [(-(a[0] + b[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound == np.inf:  # an entry without rows, and so all after it
                return
            cell = rank1[i] + rank2[j]
            if starts[cell] < starts[cell + 1]:
                yield -bound, starts[cell], starts[cell + 1]
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):  # so each cell is reached once, after one with no smaller bound
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))

    def scores(self, start: int, end: int, query: list[np.ndarray]) -> np.ndarray:
        return exact_product([r[start:end] for r in self.rows], query, self.bits)[:, 0]

    def label_range(self, start: int, end: int, label: int) -> tuple[int, int]:
        own = self.labels[start:end]
        return start + int(np.searchsorted(own, label)), start + int(np.searchsorted(own, label, "right"))


class Kept:
    """The best ``size`` rows with low <= score <= high: by falling score, then id (null last)."""

    __slots__ = ("size", "low", "high", "best", "least")

    def __init__(self, size: int, low: int, high: int):
        self.size, self.low, self.high, self.best = size, low, high, []
        self.least = low  # no smaller score can enter

    def add(self, index: MultiIndex, scores: np.ndarray, at: np.ndarray) -> None:
        fits = np.flatnonzero((scores >= self.least) & (scores <= self.high))
        if not len(fits):
            return
        if len(fits) > self.size:  # ties at the cut stay: ids decide below
            cut = np.partition(scores[fits], -self.size)[-self.size]
            fits = fits[scores[fits] >= cut]
        where = at[fits]
        if len(fits) > 4 * self.size:
            keep = np.lexsort((index.ids[where], index.null_id[where], -scores[fits]))[: self.size]
            fits, where = fits[keep], where[keep]
        new = zip((-scores[fits]).tolist(), index.null_id[where].tolist(), index.ids[where].tolist(), strict=True)
        self.best = heapq.nsmallest(self.size, [*self.best, *new])
        if len(self.best) == self.size:
            self.least = max(self.low, -self.best[-1][0])


def search(index: MultiIndex, bounds: tuple[np.ndarray, np.ndarray], query: list[np.ndarray], label: int, windows: list[Kept], same_label: bool, chunk: int = 1024) -> None:
    """Fills the windows from the index's rows of the query's label, or of all others."""
    top = max(w.high for w in windows)
    scores, places, held = [], [], 0

    def flush() -> None:
        nonlocal held, chunk
        if held:
            s, at = np.concatenate(scores), np.concatenate(places)
            near = np.flatnonzero((s >= min(w.least for w in windows)) & (s <= top))
            for w in windows if len(near) else ():
                w.add(index, s[near], at[near])
            scores.clear()
            places.clear()
            held, chunk = 0, chunk * 2

    for bound, start, end in index.cells(*bounds):
        if all(bound < w.least for w in windows):  # certified, as far as the cells seen are taken into account
            break
        a, b = index.label_range(start, end, label)
        for x, y in ((a, b),) if same_label else ((start, a), (b, end)):
            if x < y:
                scores.append(index.scores(x, y, query))
                places.append(np.arange(x, y))
                held += y - x
        if held >= chunk:
            flush()
    flush()


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


ALL = 2**62


def _windows(scores: list[int] | None, size: int, low: int, high: int) -> list[tuple[int, Kept]]:
    """For positives no window but a place among the best; for negatives one window per different positive score."""
    if scores is None:
        return [(0, Kept(size, -ALL, ALL))]
    ends = ((p, -(-low * p // 100), high * p // 100) for p in dict.fromkeys(scores))
    return [(p, Kept(size, a, b)) for p, a, b in ends if a <= b]


def _found(rows: DataFrame, queries: DataFrame, books, groups: int, size: int, scale: int, low: int = 0, high: int = 0) -> DataFrame:
    """(q, positive_score, id, score): each group's certified best rows per query, or per query and window."""
    columns = ["g", "query", "q", "id", "label", "vector", "scores"]
    row_g = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    left = rows.select(row_g.alias("g"), F.lit(False).alias("query"), F.lit(None).cast("long").alias("q"), "id", "label", "vector", F.lit(None).cast("array<bigint>").alias("scores"))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    right = queries.select(every.alias("g"), F.lit(True).alias("query"), "q", F.lit(None).cast("long").alias("id"), "label", "vector", "scores").select(columns)
    dealt = left.select(columns).unionByName(right).repartitionById(groups, "g").sortWithinPartitions("g", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, index = None, [], None
        for whole in batches:
            g, asks = (whole.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(g)]
            for start, end in zip(cuts, cuts[1:]):
                if end == start:
                    continue
                batch = whole.slice(start, end - start)
                if g[start] != group:
                    group, parts, index = g[start], [], None
                batch, values = usable(batch, "vector")
                if not len(values):
                    continue
                x, labels = floor_scaled(values, scale, values.shape[1]), batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
                if not asks[start]:
                    parts.append((x, *_ids(batch.column("id")), labels))
                    continue
                if index is None and parts:
                    index, parts = MultiIndex(*(np.concatenate(c) for c in zip(*parts, strict=True)), books), []
                if index is not None:
                    yield answers(index, batch, x, labels)

    def answers(index, batch, x, labels) -> pa.RecordBatch:
        out, first, second = [], *index.bounds(x)
        names, given = batch.column("q").to_pylist(), batch.column("scores").to_pylist()
        for i, q in enumerate(names):
            windows = _windows(given[i], size, low, high)
            if windows:
                search(index, (first[i], second[i]), limbs(x[i : i + 1], index.bits), int(labels[i]), [w for _, w in windows], given[i] is None)
                out += [(q, p, None if none else k, -s) for p, w in windows for s, none, k in w.best]
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([],) * 4)], names=["q", "positive_score", "id", "score"])

    return dealt.mapInArrow(run, "q long, positive_score long, id long, score long")


def _best(found: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The first ``size`` of each key with their ``rank``; a key has ``size`` rows per group at most."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def _whole(vector: str) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def mine(vectors: DataFrame, is_query: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, group: int = GROUP, entries: int = ENTRIES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all query rows.

    ``vectors`` has id (long), label (integer) and vector; ``is_query`` is a condition on id.
    ``low`` and ``high`` are percentages of the positive's score.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector").where("label IS NOT NULL AND vector IS NOT NULL")
    n = vectors.count()
    groups = max(1, -(-n // group), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 4096))
    stride = max(1, n // SAMPLE)
    near = rows.where(F.pmod(F.xxhash64("vector"), F.lit(stride)) == 0).where(_whole("vector")).select("vector").limit(SAMPLE).collect()
    sample = np.array([r["vector"] for r in near] or [rows.where(_whole("vector")).select("vector").first() or [[0.0]]][0], float) * scale
    books = fit_halves(sample.reshape(len(sample), -1), entries)
    asked = rows.where(F.coalesce(is_query, F.lit(False))).where(_whole("vector")).groupBy("id", "label", "vector").agg(F.count(F.lit(1)).alias("copies"))
    queries = checkpointed(asked.withColumn("q", F.monotonically_increasing_id()))  # numbers are fixed by writing them

    # One row more than wanted: the query itself may be among them. Rows equal in score and id cannot be told apart in the result.
    own = _best(_found(rows, queries.withColumn("scores", F.lit(None).cast("array<bigint>")), books, groups, positives + 1, scale), ["q"], positives + 1)
    listed = own.join(queries.select("q", F.col("id").alias("anchor"), _self_score(scale).alias("self")), "q")
    mine_ = (F.col("id") == F.col("anchor")) & (F.col("score") == F.col("self"))
    itself = F.min(F.when(mine_, F.col("rank"))).over(Window.partitionBy("q"))
    others = listed.withColumn("at", itself).where(F.col("at").isNull() | (F.col("rank") != F.col("at")))
    place = F.row_number().over(Window.partitionBy("q").orderBy("rank"))
    pairs = checkpointed(others.withColumn("place", place).where(F.col("place") <= positives).select("q", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    asks = queries.join(pairs.groupBy("q").agg(F.collect_set("positive_score").alias("scores")), "q")  # ``positives`` scores at most
    far = _best(_found(rows, asks, books, groups, negatives, scale, low, high), ["q", "positive_score"], negatives)
    out = far.select("q", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["q", "positive_score"])
    out = out.join(queries.select("q", F.col("id").alias("anchor_id"), "copies"), "q").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _self_score(scale: int) -> Column:
    """The query's inner product with itself."""
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    return F.aggregate(whole, F.lit(0).cast("long"), lambda a, x: a + x * x)


def negatives_table(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by ``every``; where it is divisible by 7, the label moves on by one of ten first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, F.col("id") % every == 0)
