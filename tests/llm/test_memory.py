import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from iqspark.llm import exact_dedup, language_id
from iqspark.sources.shared import run_dir

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def largest_batch(docs):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    return docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


def test_pipeline_bounds_batches_by_bytes(spark):
    spark.conf.unset(BATCH)
    text = F.concat(F.lit("the cat sat on the mat "), F.repeat(F.lit("and so on "), 200), F.col("id"))
    docs = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    try:
        assert corpus_pipeline.detect_language(spark, docs, "").count() == 5000
        assert largest_batch(docs) < 3_000_000
    finally:
        spark.conf.unset(BATCH)


def test_exact_dedup_keeps_a_bound_of_the_user_and_writes_few_files(spark):
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", BATCH: "500000"}
    before = {k: spark.conf.get(k, None) for k in names}
    docs = spark.range(0, 1000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 500).alias("text"))
    where = Path(run_dir(spark).removeprefix("file://"))
    there = set(where.glob("*-*"))
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = exact_dedup.exact_copies(docs)
        rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()}
        assert spark.conf.get(BATCH) == "500000"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert rows == {(i, i % 500, 2, i < 500) for i in range(1000)}
    written = {p.name.split("-")[0]: len(list(p.glob("part-*"))) for p in set(where.glob("*-*")) - there}
    assert {"shared", "classes", "ties"} <= set(written)
    assert max(written[k] for k in ("shared", "classes", "ties")) <= spark.sparkContext.defaultParallelism


def test_language_training_holds_features_once_on_the_driver(spark, monkeypatch):
    """Before, each row was held as bytes, as bytes of its sort key, and as 16 bytes for each n-gram."""
    grams, rows = 4000, 1500
    monkeypatch.setattr(language_id, "follow_leader", lambda rows, classes, *_: ([len(x) for x in (rows[0][0], rows)] and np.zeros((language_id.DIM, classes)), np.zeros(classes)))
    docs = spark.range(0, rows, 1, 4).select(F.col("id").alias("doc_id"), F.expr(f"array_join(transform(sequence(1, {grams // 4}), i -> char(19968 + pmod(xxhash64(id, i), 20000))), '')").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"))
    tracemalloc.start()
    try:
        model = language_id.train(docs)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.langs == ["a", "b"]
    assert most < 50_000_000, most
