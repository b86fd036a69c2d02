"""Exact n-gram Jaccard join with skipping by position and by what is known of similar sets.

A text's set holds its distinct 5-word shingles. Equal sets form one class. Two sets
of similarity 0.8 or more share an element among the first |x| - ceil(0.8 |x|) + 1 of
each (the prefix), in one common order of all elements: rare ones by hash, then
frequent ones, the rarest first. The frequent elements come from bounded summaries of
every part of the corpus; they only order the elements and never leave one out.

The prefixes form an index of lists, one per element, kept sorted by set size.

* Skipping in a list: an entry meets only entries of sizes from 0.8 of its own, found
  by binary search, and only if the elements after the shared position could still
  reach the needed overlap.
* Skipping by answers: the first round asks each entry only for the fitting entry of
  its list that has the fewest elements before the shared one, mostly the text that the
  others were copied from, and for its neighbour. Sets joined by these answers are
  one component, and any further pair inside a component adds no link to it, so the
  second round asks only for pairs whose components still differ. It asks for all of
  these; no component is missed.

Candidates are checked on whole sets. Sets travel as compressed texts, and only of
classes that a filter of fixed size lets through. Classes are named by 64-bit hashes
of their sets.

Null and empty texts have no set and are linked with nothing. A text under five words
has one element, the whole sequence. Repeated rows get the same result each; extra
columns are ignored by ``join_table`` and kept by ``one_per_component``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm import bits
from asofkit.llm.components import components
from asofkit.llm.text import checkpointed, gram_hashes, look_up, map_rows, mixed, word_hashes

SHINGLE = 5
FREQUENT = 300_000  # elements in the order's frequent part (16 bytes each)
PER_PART = 20_000  # summary entries of one chunk
CHUNK = 2_000_000  # elements summarised at a time
BUCKET_ENTRIES = 2_000_000
LONG = 10_000  # entries of one block of a list, where links are listed
HELD_PAIRS = 1_000_000  # pairs of a part that a task gathers before it passes them on


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a text, A-Z in lower case."""
    h = word_hashes((text or b"").lower())
    return np.unique(gram_hashes(h, min(SHINGLE, len(h)))) if len(h) else h


def class_id(elements: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes())).astype(np.int64))


def needed(size_a, size_b):
    """Smallest overlap of two sets of these sizes that reaches 0.8 of their union: 100 i >= 80 (a + b - i)."""
    return -(-4 * (size_a + size_b) // 9)


def prefix_size(n: int) -> int:
    return n - -(-4 * n // 5) + 1


class Order:
    """The common order: elements that are not frequent by hash, then frequent ones, rarest first."""

    def __init__(self, names: np.ndarray, counts: np.ndarray):
        names = names[np.lexsort((names, counts))].view(np.uint64)
        self.by_name = np.argsort(names)
        self.names = names[self.by_name]

    def prefix(self, elements: np.ndarray) -> np.ndarray:
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, elements), len(self.names) - 1)
            late = self.names[at] == elements
            if late.any():
                rank = self.by_name[at[late]]
                elements = np.concatenate([elements[~late], elements[late][np.argsort(rank)]])
        return elements[: prefix_size(len(elements))]


def _profile(key_kind: str):
    """Per part: one row per text (kind 0) and the most frequent elements of its chunks (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def summary() -> pa.RecordBatch:
            names, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            top = np.argsort(-counts, kind="stable")[:PER_PART]
            top = top[counts[top] > 1]
            return batch_of(1, [None] * len(top), np.zeros(len(top), np.int64), names[top].view(np.int64), counts[top])

        def batch_of(kind, keys, rows, names, numbers) -> pa.RecordBatch:
            key = pa.array(keys, arrow_key) if isinstance(keys, list) else keys
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), key, pa.array(rows), pa.array(names), pa.array(numbers)], names=["kind", "k", "row", "name", "n"])

        for batch in batches:
            arrow_key = batch.schema.field(0).type
            names, numbers = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, t in enumerate(batch.column(2)):
                s = shingle_set(t.as_py())
                names[i], numbers[i] = class_id(s), len(s)
                if len(s) and names[i] not in known:
                    if len(known) > 1_000_000:
                        known.clear()
                    known.add(int(names[i]))
                    held.append(s)
                    size += len(s)
                    if size >= CHUNK:
                        yield summary()
                        held, size = [], 0
            yield batch_of(0, batch.column(0), batch.column(1), names, numbers)
        if held:
            yield summary()

    return run, f"kind int, k {key_kind}, row long, name long, n long"


ENTRY = np.dtype([("element", "<u8"), ("set", "<i8"), ("n", "<i4"), ("at", "<i4")])


def _index(order, buckets: int):
    """Per part and bucket of elements: the prefix entries of its sets, each set once, as one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def pack() -> pa.RecordBatch:
            every = np.concatenate(held)
            where = (every["element"] >> np.uint64(20)) % np.uint64(buckets)
            turn = np.argsort(where, kind="stable")
            every, where = every[turn], where[turn]
            starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            parts = [x.tobytes() for x in np.split(every, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(where[starts].astype(np.int32)), pa.array(parts, pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            for t in batch.column(0):
                s = shingle_set(t.as_py())
                if not len(s) or (name := class_id(s)) in known:
                    continue
                if len(known) > 1_000_000:
                    known.clear()
                known.add(name)
                p = order.value.prefix(s)
                e = np.empty(len(p), ENTRY)
                e["element"], e["set"], e["n"], e["at"] = p, name, len(s), np.arange(len(p))
                held.append(e)
                size += len(p)
                if size >= CHUNK:
                    yield pack()
                    held, size = [], 0
        if held:
            yield pack()

    return run


def fits(n_a, at_a, n_b, at_b):
    """Whether sets that share an element at these places can still reach the needed overlap (position filter)."""
    return np.minimum(n_a - at_a, n_b - at_b) >= needed(n_a, n_b)


def runs_of(e: np.ndarray) -> np.ndarray:
    """Number of the list of each entry; entries are sorted by element."""
    return np.cumsum(np.r_[False, e["element"][1:] != e["element"][:-1]])


def first_fitting(run: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each entry the first of its list whose size is 0.8 of its own or more (lists sorted by size)."""
    width = int(n.max()) + 1
    key = run.astype(np.int64) * width + n
    return np.searchsorted(key, run.astype(np.int64) * width + -(-4 * n.astype(np.int64) // 5))


LIVE = "element long, name long, n int, at int, lead long, near long"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of lists with two sets or more, each with the two sets it asks first."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for b, e in zip(batch.column(0), batch.column(1), strict=True):
            held.setdefault(b.as_py(), []).append(np.frombuffer(e.as_buffer(), ENTRY).copy())
    for bucket in list(held):
        e = np.concatenate(held.pop(bucket))
        turn = np.argsort(e["element"], kind="stable")  # most lists have one entry: find the others before the full sort
        sorted_elements = e["element"][turn]
        same = sorted_elements[1:] == sorted_elements[:-1]
        e = e[turn[np.r_[False, same] | np.r_[same, False]]] if len(e) > 1 else e[:0]
        e = e[np.lexsort((e["set"], e["n"], e["element"]))]
        if len(e):
            e = e[np.r_[True, (e["element"][1:] != e["element"][:-1]) | (e["set"][1:] != e["set"][:-1])]]  # a set may come from several parts
            run = runs_of(e)
            alone = np.bincount(run)[run] == 1
            e = e[~alone]
        for part in _asked(e) if len(e) else ():
            yield part


def last_fitting(run: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each entry one past the last of its list of which its own size is 0.8 or more."""
    width = 2 * int(n.max()) + 2
    key = run.astype(np.int64) * width + n
    return np.searchsorted(key, run.astype(np.int64) * width + 5 * n.astype(np.int64) // 4, "right")


def lowest_in(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest of ``values[first:end]`` for every pair of bounds, by minima over powers of two."""
    out = np.empty(len(first), values.dtype)
    level = np.frompyfunc(int.bit_length, 1, 1)(end - first).astype(int) - 1
    low, width = values.copy(), 1
    for k in range(int(level.max()) + 1):
        mine = level == k
        out[mine] = np.minimum(low[first[mine]], low[end[mine] - width])
        low = np.minimum(low[:-width], low[width:]) if len(low) > width else low
        width *= 2
    return out


def hubs(e: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each entry the one of its list, of fitting size, with the fewest elements before the shared one.

    Edits put elements of their own in front, so this tends to be the text that others were copied from.
    """
    key = e["at"].astype(np.int64) << 32 | np.arange(len(e))
    return (lowest_in(key, first_fitting(run, e["n"]), last_fitting(run, e["n"])) & 0xFFFFFFFF).astype(np.int64)


def _asked(e: np.ndarray) -> Iterator[pa.RecordBatch]:
    run = runs_of(e)
    here = np.arange(len(e))
    asks = []
    for other in (hubs(e, run), np.maximum(here - 1, 0)):
        ok = (other != here) & (run[other] == run) & fits(e["n"], e["at"], e["n"][other], e["at"][other])
        asks.append((other, ~ok))
    (lead, no_lead), (near, no_near) = asks
    no_near |= (lead == near) & ~no_lead
    columns = [e["element"].view(np.int64), e["set"], e["n"], e["at"]]
    arrays = [pa.array(np.ascontiguousarray(c)) for c in columns]
    for other, no in ((lead, no_lead), (near, no_near)):
        arrays.append(pa.array(np.ascontiguousarray(e["set"][other]), mask=no))
    whole = pa.RecordBatch.from_arrays(arrays, names=["element", "name", "n", "at", "lead", "near"])
    for at in range(0, whole.num_rows, 50_000):
        yield whole.slice(at, 50_000)


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All fitting pairs of a list whose components differ and that the list did not ask for.

    Pairs leave in batches of some ``HELD_PAIRS``, each pair once per batch, so memory follows the list and not its pairs.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    c = {x: table.column(x).to_numpy() for x in ("element", "name", "n", "at", "root")}
    asked = {x: table.column(x).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for x in ("lead", "near")}
    turn = np.lexsort((c["name"], c["n"], c["element"]))
    c, asked = {k: v[turn] for k, v in c.items()}, {k: v[turn] for k, v in asked.items()}
    run = np.cumsum(np.r_[False, c["element"][1:] != c["element"][:-1]])
    longest = np.arange(len(run)) - first_fitting(run, c["n"])  # entries before each that its size allows
    out, size = [], 0

    def packed() -> Iterator[pa.RecordBatch]:
        found = np.concatenate(out)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        found = found[np.r_[True, (found[1:] != found[:-1]).any(axis=1)]]
        for at in range(0, len(found), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[at : at + 50_000, i])) for i in (0, 1)], names=["a", "b"])

    active, step = np.arange(len(run)), 0
    while True:
        step += 1
        active = active[longest[active] >= step]
        if not len(active):
            break
        other = active - step
        ok = (c["root"][active] != c["root"][other]) & fits(c["n"][active], c["at"][active], c["n"][other], c["at"][other])
        for x, y in ((active, other), (other, active)):  # not what this list asked before
            ok &= (asked["lead"][x] != c["name"][y]) & (asked["near"][x] != c["name"][y])
        i, j = active[ok], other[ok]
        if len(i):
            swap = c["name"][i] > c["name"][j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            out.append(np.stack([c["name"][i], c["name"][j]], axis=1))
            size += len(i)
            if size >= HELD_PAIRS:
                yield from packed()
                out, size = [], 0
    if out:
        yield from packed()


def _packed(needed_bits):
    """Of each set that the filter lets through: its name and its compressed text, once per part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            names, texts = [], []
            for t in batch.column(0):
                raw = t.as_py()
                s = shingle_set(raw)
                if not len(s) or (name := class_id(s)) in known or not needed_bits.value[bits.places(mixed(np.array([name]).view(np.uint64)))[0]]:
                    continue
                known.add(name)
                names.append(name)
                texts.append(packer.compress(b" ".join(raw.lower().split())))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(texts, pa.binary())], names=["name", "packed"])

    return run


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose whole sets are similar enough."""
    opener = zstandard.ZstdDecompressor()
    last, left = None, None
    for batch in batches:
        keep = []
        for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "packed_a", "packed_b")), strict=True):
            if (name := b.as_py()) != last:
                last, left = name, shingle_set(opener.decompress(y.as_py()))
            other = shingle_set(opener.decompress(x.as_py()))
            i = len(np.intersect1d(left, other, assume_unique=True))
            keep.append(100 * i >= 80 * (len(left) + len(other) - i))
        ok = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])


def _verified(bodies: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) that are linked."""
    spark = pairs.sparkSession
    spread = pairs.select(F.explode(F.array("a", "b")).alias("name"))

    def scramble(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mixed(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], names=["name"])

    wanted = spark.sparkContext.broadcast(bits.gather(spread.mapInArrow(scramble, "name long"), "name"))  # 2^22 places
    packed = bodies.mapInArrow(_packed(wanted), "name long, packed binary")
    packed = checkpointed(packed.groupBy("name").agg(F.first("packed").alias("packed")))
    one = packed.select(F.col("name").alias("a"), F.col("packed").alias("packed_a"))
    two = packed.select(F.col("name").alias("b"), F.col("packed").alias("packed_b"))
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "packed_a", "packed_b")
    return full.mapInArrow(_checked, "a long, b long")


def _listed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their sets' names and sizes, the texts, and the entries of all lists with two sets or more."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    run, schema = _profile(kind)
    source = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("row"), F.col(text).cast("binary").alias("body"))
    profile = checkpointed(source.mapInArrow(run, schema))
    rows = profile.where("kind = 0").drop("kind")
    frequent = profile.where("kind = 1").groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(FREQUENT)
    top = frequent.toArrow()  # FREQUENT rows at most
    order = spark.sparkContext.broadcast(Order(top.column("name").to_numpy().astype(np.int64), top.column("n").to_numpy().astype(np.int64)))
    entries = rows.agg(F.sum(F.col("n") - F.ceil(0.8 * F.col("n")) + 1)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(entries) // BUCKET_ENTRIES + 1)
    bodies = source.select("body")
    lists = bodies.mapInArrow(_index(order, 4 * buckets), "bucket int, entries binary").repartition(buckets, "bucket").mapInArrow(_lists, LIVE)
    return rows, bodies, checkpointed(lists)


def membership(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: k, row (hash of the text), name of its set, n (its size) and root (None: in no link between sets)."""
    rows, bodies, lists = _listed(docs, key, text)
    asked = lists.where("lead IS NOT NULL").select("name", F.col("lead").alias("other")).union(lists.where("near IS NOT NULL").select("name", F.col("near").alias("other")))
    ordered = lambda p: p.select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b")).distinct()
    first = checkpointed(ordered(asked))
    linked = checkpointed(_verified(bodies, first))
    roots = components(linked)
    # Round 2: lists that still meet several components
    placed = lists.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    mixed_lists = placed.groupBy("element").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("element")
    still = placed.join(mixed_lists, "element").repartition("element").mapInArrow(_open_pairs, "a long, b long").distinct()
    second = checkpointed(still.join(first, ["a", "b"], "left_anti"))
    more = checkpointed(_verified(bodies, second))
    merged = components(linked.union(more))
    return rows.join(merged.withColumnRenamed("node", "name"), "name", "left").select("k", "row", "name", "n", "root")


def join_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key reachable by links) and class_id of its set."""
    rows = checkpointed(membership(docs, key, text))
    group = F.when(F.col("n") > 0, F.coalesce("root", "name"))
    lowest = checkpointed(rows.where("n > 0").groupBy(group.alias("group")).agg(F.min("k").alias("component_id"), F.count(F.lit(1)).alias("rows")))
    return look_up(rows.withColumn("group", group), "group", lowest, "rows").select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("k")).alias("component_id"), F.col("name").alias("class_id"))


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the row with the smallest key (null first; then the smallest text hash); rows without a set stay."""
    rows = checkpointed(membership(docs, key, text)).where("n > 0").withColumn("group", F.coalesce("root", "name"))
    seen = checkpointed(rows.groupBy("k", "row", "group").agg(F.count(F.lit(1)).alias("c")))
    lowest = checkpointed(seen.groupBy("group").agg(F.min(F.struct("k", "row")).alias("m"), F.count(F.lit(1)).alias("rows")))
    stays = F.col("k").eqNullSafe(F.col("m.k")) & (F.col("row") == F.col("m.row"))
    # rows that go, and rows that stay once of several: all others pass without a join
    touched = look_up(seen, "group", lowest, "rows").where(~stays | (F.col("c") > 1))
    touched = checkpointed(touched.select(F.xxhash64("k", "row").alias("t"), F.col("k").alias("t_key"), F.col("row").alias("t_row"), stays.alias("stays")))
    hashed = docs.select(F.struct(*docs.columns).alias("doc"))  # so that no column's name clashes
    own, body = F.col("doc").getField(key), F.xxhash64(F.col("doc").getField(text))
    maybe, clear = bits.split(hashed.withColumn("h", F.xxhash64(own, body)), "h", touched, "t")
    same = (F.col("h") == F.col("t")) & own.eqNullSafe(F.col("t_key")) & (body == F.col("t_row"))
    untouched = maybe.join(touched, same, "left_anti")
    once = maybe.join(touched.where("stays"), same, "left_semi").dropDuplicates(["h"])
    return clear.union(untouched).union(once).select("doc.*")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every link between different sets, once: class_a < class_b and the rows of each class (``join_table`` has each row's class_id).

    Lists of over ``LONG`` entries are cut into blocks by the hash of the set, and each
    pair of blocks is a key of its own in the join.
    """
    rows, bodies, lists = _listed(docs, key, text)
    entries = lists.select("element", "name", "n", "at")
    long = entries.groupBy("element").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > LONG).select("element", F.ceil(F.col("c") / LONG).cast("int").alias("blocks"))
    dealt = entries.join(long, "element", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    x = dealt.select("element", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("name").alias("x"), F.col("n").alias("n_x"), F.col("at").alias("at_x"))
    y = dealt.select("element", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.col("name").alias("y"), F.col("n").alias("n_y"), F.col("at").alias("at_y"))
    met = x.join(y, ["element", "i", "j"]).where("(i < j OR x < y) AND 9 * least(n_x - at_x, n_y - at_y) >= 4 * (n_x + n_y)")  # each two once; as in ``fits``
    found = _verified(bodies, checkpointed(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))
    copies = rows.where("n > 0").groupBy("name").agg(F.count(F.lit(1)).alias("c"))
    one = copies.select(F.col("name").alias("a"), F.col("c").alias("rows_a"))
    two = copies.select(F.col("name").alias("b"), F.col("c").alias("rows_b"))
    return found.join(one, "a").join(two, "b").select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "rows_a", "rows_b")
