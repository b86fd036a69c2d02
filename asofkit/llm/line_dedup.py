"""Lines that occur in many documents, found and dropped with DataFrame functions only.

Lines are normalised (ASCII white space stripped at both ends, A-Z lower-cased) and named
by two 64-bit hashes. Each document counts a name once, so a name's count is the number
of its documents; only names and counts are shuffled, after partial counts in each task.
Names at or over the threshold are looked up from the lines: the commonest ones by a
broadcast (with a bound of ``heavy`` on the counts' total share, at most ``heavy`` names
can qualify, however large the tables are), the others, none of which holds more than
1/heavy of the counted lines, by a join on the name. A hot line therefore needs no task
of its own. Positions to drop meet the split texts by row, and the other lines are joined
in their order.

A document is one row; repeated rows and rows with equal ids count one by one. A null or
empty text is one empty line. Lines whose key has fewer than ``min_chars`` code points
are never dropped and not counted. A document may lose all lines (empty text). Extra
columns are ignored by ``line_digests`` and kept by ``without_common_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.llm.text import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIPPED = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _named(rows: DataFrame, key: str) -> DataFrame:
    """Adds the name (h1, h2) of the key's text."""
    return rows.withColumn("h1", F.xxhash64(key)).withColumn("h2", F.xxhash64(F.lit("second"), F.col(key))).drop(key)


def common_lines(docs: DataFrame, text: str = "text", min_chars: int = 1, min_docs: int = 10) -> DataFrame:
    """Names (h1, h2) of the line keys found in at least ``min_docs`` documents, with ``n_docs``."""
    own = F.explode(F.array_distinct(F.transform(_lines_of(F.col(text)), line_key)))
    keys = docs.select(own.alias("key")).where(F.char_length("key") >= min_chars)
    return _named(keys, "key").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def dropped_positions(docs: DataFrame, row: str, text: str = "text", min_chars: int = 1, min_docs: int = 10, heavy: int = 50_000) -> DataFrame:
    """Per row that loses lines: ``row`` and the positions of these lines (from 0, ``drops``)."""
    common = checkpointed(common_lines(docs, text, min_chars, min_docs))
    total = common.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    is_heavy = F.col("n_docs") * heavy >= total  # at most ``heavy`` names
    names = lambda rows: rows.select("h1", "h2", F.lit(True).alias("found"))
    lines = docs.select(row, F.posexplode(_lines_of(F.col(text))).alias("pos", "line")).select(row, "pos", line_key(F.col("line")).alias("key"))
    looked = _named(lines.where(F.char_length("key") >= min_chars), "key").join(F.broadcast(names(common.where(is_heavy))), ["h1", "h2"], "left")
    rest = looked.where("found IS NULL").drop("found").join(names(common.where(~is_heavy)), ["h1", "h2"])
    hit = looked.where("found").select(row, "pos").unionByName(rest.select(row, "pos"))
    return hit.groupBy(row).agg(F.collect_list("pos").alias("drops"))


def _split_docs(docs: DataFrame, text: str, **limits) -> DataFrame:
    """``doc`` (a struct of all columns, so that no name clashes), ``lines`` and ``drops`` (null: none).

    A row's name is its number in the scan, which is the same each time the files are read.
    """
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc"))
    drops = dropped_positions(named.select("row", F.col("doc").getField(text).alias("text")), "row", **limits)
    split = named.select("row", F.col("doc").withField(text, F.lit(None).cast("string")).alias("doc"), _lines_of(F.col("doc").getField(text)).alias("lines"))
    return split.join(drops, "row", "left")


def _kept() -> Column:
    """The remaining lines in their order; array_except works by hashing, so a long text costs no more per line."""
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    return F.array_join(F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i))), "\n")


def without_common_lines(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """All rows and columns, ``text`` without the common lines (a null text comes back empty)."""
    return _split_docs(docs, text, **limits).select(*(_kept().alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns))


def line_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Per row: key, n_lines, n_dropped and the SHA-256 of the text that stays."""
    rows = _split_docs(docs.select(key, text), text, **limits)
    return rows.select(F.col("doc").getField(key).alias(key), F.size("lines").cast("long").alias("n_lines"),
                       F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(_kept(), 256).alias("kept_sha256"))
