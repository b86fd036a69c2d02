import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))  # the repository's top

from asofkit.session import local_session  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("asofkit-tests", cpus=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return s


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names clash with results."""

    def make(pairs):
        rows = [(k, t, "en", "s", len(t) if t is not None else None) for k, t in pairs]
        return spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("x")).withColumn("n_tokens", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("spans", F.lit("y"))

    return make


@pytest.fixture(scope="session")
def edge_docs(docs_of):
    return docs_of([(1, None), (2, ""), (3, " \n\t "), (None, "no key"), (4, "same text"), (4, "same text"), (5, "x" * 300_000), (6, "word " * 60_000), (7, "ünï çödé 日本語 🦊\u0000\x1f")])
