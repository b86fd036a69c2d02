"""Reading and writing: declared schemas, manifests, sealed scans, run metrics, registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofkit.functions.hashing import content_number
from asofkit.operators.contracts import ContractError, duplicate_keys


# ------------------------------------------------------------------ datasets with a manifest
def manifest(df: DataFrame, *, entity: str, index: str, y: str, versions: Mapping[str, str]) -> DataFrame:
    """One row: counts, date range, prevalence, and an order-free content number of all columns."""
    t = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"), F.min(index).alias("first_index_date"), F.max(index).alias("last_index_date"),
               F.avg(F.col(y).cast("double")).alias("prevalence"), content_number(*sorted(df.columns)).cast("string").alias("content"))
    return t.withColumns({k: F.lit(v) for k, v in versions.items()})


def write_dataset(df: DataFrame, path: str, *, entity: str, index: str, y: str, versions: Mapping[str, str]) -> None:
    """Immutable write: version columns added, one folder per index date, manifest next to the data; an existing target is refused.

    Rows are gathered by index date; adaptive execution splits a date by its size, so it may hold any share of them.
    The manifest is computed from the written files, so it describes what a reader will find.
    """
    out = df.withColumns({k: F.lit(v) for k, v in versions.items()})
    out.hint("rebalance", index).write.partitionBy(index).mode("errorifexists").parquet(f"{path}/data")
    written = df.sparkSession.read.schema(out.schema).parquet(f"{path}/data")
    manifest(written, entity=entity, index=index, y=y, versions=versions).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


MANIFEST_SCHEMA = "rows long, entities long, first_index_date string, last_index_date string, prevalence double, content string"


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | str, *, verify: str = "rows") -> DataFrame:
    """Read with the declared schema and column order; refuse when the data differ from the manifest.

    ``verify``: "rows" compares the row count, which the files' footers give; "content" hashes every row; "" skips it.
    A filter on the index date reads the folders of its dates only.
    """
    df = spark.read.schema(schema).parquet(f"{path}/data")
    df = df.select(*(schema.fieldNames() if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema).fieldNames()))
    if verify:
        want = spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest").first()
        got = {"rows": spark.read.option("recursiveFileLookup", True).parquet(f"{path}/data").count()}  # stray files too
        if verify == "content":
            got |= df.agg(content_number(*sorted(df.columns)).cast("string").alias("content")).first().asDict()
        if want is None or any(want[k] != v for k, v in got.items()):
            raise ContractError(f"{path}: data do not match the manifest")
    return df


def subset_schema(columns: Sequence[str], full: T.StructType, subset: Sequence[str]) -> T.StructType:
    """The full schema when every column is present, the declared subset when exactly those are, else an error."""
    names = set(full.fieldNames())
    have = set(columns)
    if names <= have:
        return full
    if set(subset) <= have:
        return T.StructType([f for f in full.fields if f.name in set(subset)])
    raise ContractError(f"columns fit neither the full nor the subset schema; absent: {sorted(set(subset) - have)}")


# ------------------------------------------------------------------ text tables
def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed CSV: declared types only, leading zeros kept, empty cell NULL, a malformed row stops the job."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("nullValue", "").option("enforceSchema", False).csv(path)


def read_wide_text(spark: SparkSession, path: str, columns: Sequence[str], *, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A wide extract as text with SQL NULL literals, to be cast by the contract."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding).option("nullValue", "NULL").csv(path)


def header(spark: SparkSession, path: str, fmt: str = "parquet", sep: str = ",") -> list[str]:
    """Column names only; duplicated names are refused. Of a text file the first line is read, with its separator and quoting."""
    if fmt == "parquet":
        names = spark.read.parquet(path).schema.names
    else:
        first = spark.read.option("header", False).option("sep", sep).option("inferSchema", False).csv(path).limit(1).first()
        names = [] if first is None else [(c or "").strip() for c in first]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ContractError(f"duplicate columns: {twice}")
    return list(names)


def write_aggregate(df: DataFrame, path: str, *, basis: str, watermark: str) -> None:
    """Small aggregate table as one CSV file; basis and watermark are columns."""
    df.withColumn("basis", F.lit(basis)).withColumn("watermark", F.lit(watermark)).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


# ------------------------------------------------------------------ sealed scans
def sealed_read(df: DataFrame, columns: Sequence[str], sealed: Mapping[str, str]) -> DataFrame:
    """Only the requested columns; a sealed one is refused before anything is read. The select reaches the parquet reader."""
    hit = {c: sealed[c] for c in columns if c in sealed}
    if hit:
        raise PermissionError(f"sealed columns requested: {hit}")
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ContractError(f"absent columns: {absent}")
    return df.select(*columns)


def outcome_only(df: DataFrame, key: str, outcomes: Sequence[str]) -> DataFrame:
    """Key and outcome columns, apart from the predictors."""
    return df.select(key, *outcomes)


# ------------------------------------------------------------------ predictions and runs
def write_predictions(df: DataFrame, path: str, keys: Sequence[str], y: str, risks: Sequence[str]) -> None:
    df.select(*keys, y, *risks).write.mode("errorifexists").parquet(path)


def read_predictions(spark: SparkSession, path: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Predictions with the required columns; duplicate keys are refused."""
    df = spark.read.parquet(path)
    absent = [c for c in (*keys, *columns) if c not in df.columns]
    if absent:
        raise ContractError(f"predictions lack {absent}")
    extra = duplicate_keys(df, keys).first()["extra_rows"]
    if extra:
        raise ContractError(f"{extra} duplicated prediction rows")
    return df.select(*keys, *columns)


RUN_SCHEMA = ("run_id string, created string, kind string, data_hash string, rows_hash string, "
              "performance map<string, map<string, map<string, struct<estimate: double, ci_low: double, ci_high: double>>>>")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics JSON of every COMPLETED run (a run without its marker file is skipped)."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    metrics = spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(f"{folder}/*/metrics.json").withColumn("folder", name)
    done = spark.read.text(f"{folder}/*/COMPLETED").select(name.alias("folder")).distinct()
    return metrics.join(done, "folder", "left_semi")


REGISTRY_SCHEMA = "evaluation string, data_hash string, rows_hash string, config_hash string, registered timestamp"


def register_evaluation(spark: SparkSession, path: str, data_hash: str, rows_hash: str, config_hash: str, *, exists: bool = True) -> str:
    """Append one evaluation BEFORE the test rows are released; the same (data, rows, config) may be evaluated once.

    Each evaluation is a folder named by its hash, written with errorifexists, so a second writer of
    the same evaluation meets the folder and fails.
    """
    row = spark.range(1).select(F.sha2(F.concat_ws("|", F.lit(data_hash), F.lit(rows_hash), F.lit(config_hash)), 256).alias("evaluation"), F.lit(data_hash).alias("data_hash"),
                                F.lit(rows_hash).alias("rows_hash"), F.lit(config_hash).alias("config_hash"), F.current_timestamp().alias("registered"))
    name = row.first()["evaluation"]
    if exists:
        prior = spark.read.schema(REGISTRY_SCHEMA).parquet(path)
        same = (F.col("data_hash") == data_hash) & (F.col("rows_hash") == rows_hash) & (F.col("config_hash") == config_hash)
        if not prior.where(same).isEmpty():
            raise ContractError("this evaluation was registered before")
    try:
        row.drop("evaluation").write.mode("errorifexists").parquet(f"{path}/evaluation={name}")
    except AnalysisException as e:
        raise ContractError("this evaluation was registered before") from e
    return name
