"""Benchmark decontamination by winnowing.

Of every 6 neighbouring 5-word hashes the smallest is kept, in items and documents
alike, so every run of 10 shared words has a kept hash in common. Kept hashes of
documents pass a filter of fixed size that holds the items' kept hashes, then join
them in Spark; each joined pair is extended word by word to the left and right and
counts if the shared run reaches 10 words. Items of 1 to 9 words are one window each:
their whole hash is looked for at every place of a document.

Null and empty texts have no words. A null item id marks words but is not listed.
Repeated rows get the same result each. Extra columns are ignored by ``hit_table``
and kept by ``clean_documents``. An empty table of items leaves every document clean.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm import bits
from asofkit.llm.text import checkpointed, gram_hashes, map_rows, mixed, word_hashes

WINDOW, GRAM = 10, 5
REACH = WINDOW - GRAM
#: ASCII letters in lower case, digits and bytes of other characters stay; all else separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def hashes_of(text: bytes | None) -> np.ndarray:
    return word_hashes((text or b"").translate(WORD_BYTES))


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window of neighbouring hashes, each place once."""
    n = len(grams) - window + 1
    low, at = grams[:n].copy(), np.arange(n)
    for i in range(1, window):
        next_one = grams[i : i + n]
        less = next_one < low
        low = np.where(less, next_one, low)
        at = np.where(less, np.arange(i, i + n), at)
    kept = np.zeros(len(grams), bool)
    kept[at] = True
    return np.flatnonzero(kept)


def prints(h: np.ndarray, short: list[int], keep: np.ndarray | None = None):
    """(size, hash, place, first word of the context, context) of kept hashes; size 0: winnowed, else a whole short window."""
    n = len(h)
    signed = h.view(np.int64)
    if n >= WINDOW:
        g = gram_hashes(h, GRAM)
        at = winnowed(g, REACH + 1)
        if keep is not None:
            at = at[keep[bits.places(mixed(g[at]))]]
        for p in at.tolist():
            a = max(0, p - REACH)
            yield 0, int(g.view(np.int64)[p]), p, a, signed[a : p + WINDOW].tolist()
    for size in short:
        if n >= size:
            g = gram_hashes(h, size)
            at = np.flatnonzero(keep[bits.places(mixed(g))]) if keep is not None else np.arange(len(g))
            for p in at.tolist():
                yield size, int(g.view(np.int64)[p]), p, p, signed[p : p + size].tolist()


PRINT = "size int, print long, place int, first int, context array<long>"


def item_prints(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    def one(k, t):
        h = hashes_of(t)
        for p in prints(h, [len(h)] if 0 < len(h) < WINDOW else []):
            yield (k, *p, int(mixed(np.array([p[1]]).view(np.uint64)).view(np.int64)[0]))

    kind = benchmark.schema[item].dataType.simpleString()
    return map_rows(benchmark.select(F.col(item), F.col(text).cast("binary")), one, f"item {kind}, {PRINT}, spread long")


def shared_run(place: int, first: int, context: list[int], other_place: int, other_first: int, other: list[int]) -> tuple[int, int] | None:
    """Words [start, end) of the document around the print that the item shares."""
    i, j = place - first, other_place - other_first
    if context[i : i + GRAM] != other[j : j + GRAM]:
        return None
    left = right = 0
    while left < min(i, j) and context[i - left - 1] == other[j - left - 1]:
        left += 1
    i, j = i + GRAM, j + GRAM
    while right < min(len(context) - i, len(other) - j) and context[i + right] == other[j + right]:
        right += 1
    return (place - left, place + GRAM + right) if left + GRAM + right >= WINDOW else None


def hit_table(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``row_hash`` of the text, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    items = checkpointed(item_prints(benchmark))
    keep = spark.sparkContext.broadcast(bits.gather(items, "spread"))  # 2^22 places, whatever the benchmark's size
    short = [r["size"] for r in items.where("size > 0").select("size").distinct().collect()]  # 9 sizes at most
    kind = docs.schema[key].dataType.simpleString()

    def scan(k, row, t):
        h = hashes_of(t)
        yield (k, row, len(h), [dict(zip(("size", "print", "place", "first", "context"), p, strict=True)) for p in prints(h, short, keep.value)] if len(h) else [])

    source = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("row"), F.col(text).cast("binary"))
    seen = checkpointed(map_rows(source, scan, f"k {kind}, row long, n_words long, prints array<struct<size:int,print:long,place:int,first:int,context:array<long>>>", 512))
    candidates = seen.select("k", "row", F.explode("prints").alias("p")).select("k", "row", "p.*").distinct()
    theirs = items.select("item", "size", "print", F.col("place").alias("item_place"), F.col("first").alias("item_first"), F.col("context").alias("item_context"))

    def extend(k, row, item, size, place, first, context, item_place, item_first, item_context):
        if size:
            if context == item_context:
                yield k, row, item, place, place + size
        elif span := shared_run(place, first, context, item_place, item_first, item_context):
            yield k, row, item, *span

    joined = candidates.join(theirs, ["size", "print"]).select("k", "row", "item", "size", "place", "first", "context", "item_place", "item_first", "item_context")
    hits = checkpointed(map_rows(joined, extend, f"k {kind}, row long, item {benchmark.schema['item_id'].dataType.simpleString()}, start int, end int").distinct())
    ordered = Window.partitionBy("k", "row").orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = hits.select("k", "row", "start", "end").distinct().withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach))).groupBy("k", "row").agg(F.sum("new").alias("n_hit"))
    named = hits.groupBy("k", "row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    per_row = counted.join(named, counted.k.eqNullSafe(named.k) & (counted.row == named.row)).select(counted.k, counted.row, "n_hit", "items")
    s, p = seen.alias("s"), per_row.alias("p")
    listed = F.coalesce(F.col("p.items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("p.n_hit"), F.lit(0)).cast("long")
    return s.join(p, F.col("s.k").eqNullSafe(F.col("p.k")) & (F.col("s.row") == F.col("p.row")), "left").select(
        F.col("s.k").alias(key), F.col("s.row").alias("row_hash"), F.col("s.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without a benchmark window, with all their columns."""
    hit = hit_table(docs, benchmark, key, text).where("contaminated").select(F.col(key).alias("hit_key"), F.col("row_hash").alias("hit_row")).distinct()
    hit = checkpointed(hit.withColumn("hit", F.xxhash64("hit_key", "hit_row")))
    own, body = F.col("doc").getField(key), F.xxhash64(F.col("doc").getField(text))
    packed = docs.select(F.struct(*docs.columns).alias("doc"))  # so that no column's name clashes
    maybe, clear = bits.split(packed.withColumn("h", F.xxhash64(own, body)), "h", hit, "hit")
    left = maybe.join(hit, (F.col("h") == F.col("hit")) & own.eqNullSafe(F.col("hit_key")) & (body == F.col("hit_row")), "left_anti")
    return clear.union(left).select("doc.*")
