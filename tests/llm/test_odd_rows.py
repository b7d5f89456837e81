"""Every pipeline stage and operator over odd rows: nulls, repeats, other id types, columns whose names clash."""

import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logsieve.llm import decontaminate, media, minhash, mixing, quality, reclm, registry, secrets, suffixes, tokenids, toxicity

TABLES = "/root/testdata/sf0.001"
#: Names that operators use for results or inside.
NAMES = (
    "_hits", "_items", "_n_words", "_n_hit", "_quality", "_digest", "_key", "_text", "_row", "_words", "size", "source_size", "target", "place",
    "key", "row", "position", "positions", "label", "v", "row_number", "planes", "bands", "digest", "at", "part", "base", "shard", "score",
    "n_bytes", "n_tokens", "_order", "_label", "_id", "a", "b", "hub",
)


def odd(spark, empty=False):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    if empty:
        return named(docs.limit(0))
    long = " ".join(f"w{i % 713} v{i}" for i in range(30_000))
    prose = docs.where("length(text) > 400").first().text
    rows = [
        (None, None, None, None, None), (None, "", "en", None, 0), (None, prose, "en", "src0", 1), (None, prose + " end", "en", "src0", 1),
        (7, prose.upper(), None, "src1", 5), (7, prose.upper(), None, "src1", 5), (7, "other words here", "en", "src1", 5),
        (90001, long, "en", "src2", 5), (90002, long, "en", "src2", 5), (90003, "x" * 100_000, "en", "src2", 5), (90004, " \t\n", "en", "", 3),
    ]
    return named(docs.unionByName(spark.createDataFrame(rows, docs.schema)))


def named(docs):
    return docs.withColumns({c: F.lit("mine") for c in NAMES})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    for name in ("benchmark", "labels"):
        shutil.copy(f"{TABLES}/{name}.parquet", path)
    odd(spark).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns, name
        kept = found.select(*NAMES).distinct().collect()
        assert [tuple(r) for r in kept] == [("mine",) * len(NAMES)], name
        none = stage(spark, docs.limit(0), folder)
        assert none.columns == docs.columns and none.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.slot for r in found) == list(range(len(found))) and found


def test_run_takes_empty_tables(spark, tmp_path):
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{TABLES}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    odd(spark, empty=True).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in registry.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_each_query(spark, folder, name):
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    found = registry.queries()[name](spark, folder)
    assert found.count() == n or name == "op1_token_ids"


def test_ids_of_text(spark):
    """Ids are of any type; they come back as they are."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(60).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    benchmark = spark.read.parquet(f"{TABLES}/benchmark.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for found in (
        quality.report(docs, labels), toxicity.report(docs, labels), minhash.report(docs), suffixes.report(docs), media.report(docs),
        mixing.report(docs), reclm.report(docs), secrets.report(docs), decontaminate.report(docs, benchmark),
    ):
        assert {r.doc_id for r in found.select("doc_id").collect()} == ids
    assert {r.first_doc_id for r in tokenids.report(docs).collect()} <= ids


def test_scratch_removes_what_is_not_kept(spark):
    from logsieve.llm.common import materialize, scratch

    with scratch(spark) as outer:
        with scratch(spark) as inner:
            a, b = materialize(spark.range(3), "a"), materialize(spark.range(4), "b")
            inner.keep(b)
        assert b.count() == 4
        with pytest.raises(Exception):  # noqa: B017
            a.count()
        outer.keep(b)
    assert b.count() == 4
