"""Corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iqspark.llm import decontamination, language_id, mixing, ngram_join, token_store
from iqspark.llm.common import bounded, materialize, new_path, small_batches, table, text_key
from iqspark.llm.queries import tokenizer_path

#: Least calibrated probability of a document's language.
LEAST_SCORE = 0.5


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: und (no letters) and scores under LEAST_SCORE go."""
    small_batches(spark)
    model = language_id.train(docs.where(~language_id.held_out()))
    names = ("__lang_pred", "__score")
    return language_id.predict(docs, model, names).where((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_SCORE)).drop(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that comes first of each group of near copies, by doc_id (rows without one last); texts without words all
    stay. Rows are told apart by doc_id and text: those with equal ids and texts become one, the one whose JSON comes first. Texts are not shuffled while
    the rows that go, or that repeat, are few."""
    small_batches(spark)
    own = [F.col("doc_id").alias("d"), F.col("text_key").alias("t")]
    found = ngram_join.similar_rows(docs).groupBy(*own).agg(F.max("n").alias("n"), F.max("first").alias("first"), F.count("*").alias("c"))
    stays = F.expr("n = 0 OR (d <=> first.doc_id AND t = first.text_key)")
    found = materialize(found.select("d", "t", stays.alias("stays"), F.expr("c > 1 AND (n > 0 OR d IS NOT NULL)").alias("repeats")).where("NOT stays OR repeats"), "copies")
    gone, repeated = bounded(found.where("NOT stays").select("d", "t"), "gone"), bounded(found.where("stays").select("d", "t"), "repeated")
    left = docs.join(gone, same_row(docs, gone), "left_anti")
    once = left.join(repeated, same_row(left, repeated), "left_anti")
    again = left.join(repeated, same_row(left, repeated), "left_semi").groupBy(F.col("doc_id").alias("d"), text_key(F.col("text")).alias("t"))
    row = F.struct(*docs.columns)
    return once.union(again.agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*"))


def same_row(docs: DataFrame, keys: DataFrame) -> Column:
    """A row of keys(d, t) names a row of docs(doc_id, text)."""
    return docs.doc_id.cast("long").eqNullSafe(keys.d) & (text_key(docs.text) == keys.t)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's template."""
    small_batches(spark)
    found = decontamination.template_matches(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).distinct()
    found = bounded(found, "benchmarked")
    return docs.join(found, same_row(docs, found), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, in a global shuffle."""
    return mixing.poisson_mix(docs, copy="__copy", position="__position").drop("__copy", "__position")


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in a content-addressed store, and what its files give back for each document."""
    small_batches(spark)
    return token_store.token_store(docs, tokenizer_path())


STAGES = [("language_id", detect_language), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark), ("mixing", mix_sources), ("token_store", store_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
