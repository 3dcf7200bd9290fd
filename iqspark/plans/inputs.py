"""The given tables as sweeps, frames, packets, tones, calibrations, snapshots and counters (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sweep_e(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda t: F.struct(F.get("embedding", t * 2).cast("double").alias("i"), F.get("embedding", t * 2 + 1).cast("double").alias("q")))
    rows = table(spark, d, "embeddings").select(F.col("label").alias("point"), F.col("vec_id").alias("sample"), F.posexplode(pairs).alias("tone", "z"))
    f = F.lit(2e9) + F.col("tone") * 1e6 + (F.col("point") - 4.5) * 1e4
    return rows.select(F.lit("E").alias("sweep_id"), "tone", "point", "sample", f.alias("f"), "z.i", "z.q", F.lit(0).alias("packet_error"))


def sweep_l(spark: SparkSession, d: str) -> DataFrame:
    point = (F.col("l_linenumber") - 1).cast("int")
    rows = table(spark, d, "lineitem").select(F.lit("L").alias("sweep_id"), F.col("l_suppkey").cast("int").alias("tone"), point.alias("point"), (F.col("l_quantity").cast("double") - 25.5).alias("i"), (F.col("l_discount").cast("double") * 100 - 5).alias("q"), F.lit(0).alias("packet_error"))
    return rows.withColumn("f", F.lit(1e9) + F.col("tone") * 1e5 + F.col("point") * 1e4)


def frames_e(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    part = lambda off: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda t: F.round(F.get("embedding", t * 2 + off).cast("double") * 2**20).cast("int"))
    flags = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (F.col("label") == k).cast("int"))
    return e.select(F.lit("E").alias("stream_id"), F.col("vec_id").cast("long").alias("seq"), (F.col("vec_id") + F.lit(3) * F.floor(F.col("vec_id") / 100)).cast("long").alias("packet_counter"), (F.col("label") == 9).cast("int").alias("packet_error"), flags.alias("flags"), part(0).alias("i"), part(1).alias("q"))


def packets_v(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("packet_counter"), (F.col("event_type") == "error").cast("int").alias("packet_error"), F.array((F.col("event_type") == "click").cast("int")).alias("flags"), "ts")


def tones_p(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("tone_set"), F.col("p_partkey").alias("tone"), (F.col("p_retailprice").cast("double") * 1e6 + F.col("p_partkey")).alias("freq_hz"), (F.col("p_size") / 50).cast("double").alias("amplitude"))


def cal_s(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.lit("S").alias("cal_id"), F.col("s_suppkey").cast("long").alias("cal_order"), (F.lit(8.5e8) + F.col("s_suppkey") * 1.5e6).alias("freq_hz"), (F.col("s_acctbal").cast("double") / 1e4).alias("value_db"))


def snapshot_l(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("dac"), F.round((F.col("l_quantity").cast("double") - 25) * 1400).cast("int").alias("i"), F.round(F.col("l_discount").cast("double") * -330000).cast("int").alias("q"))


def counters_o(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("board"), F.col("o_orderstatus").alias("block"), F.struct("o_orderdate", "o_orderkey").alias("ts"), F.col("o_custkey").cast("long").alias("count"))


#: The same inputs in SQL, as common table expressions.
SQL = {
    "e": "e AS (SELECT 'E' AS sweep_id, t::INT AS tone, label AS point, vec_id AS sample, embedding[2*t+1]::DOUBLE AS i, embedding[2*t+2]::DOUBLE AS q, 2e9 + t*1e6 + (label-4.5)*1e4 AS f FROM embeddings, range(32) r(t))",
    "l": "l AS (SELECT 'L' AS sweep_id, l_suppkey::INT AS tone, (l_linenumber-1)::INT AS point, l_quantity::DOUBLE-25.5 AS i, l_discount::DOUBLE*100-5 AS q, 1e9 + l_suppkey*1e5 + (l_linenumber-1)*1e4 AS f FROM lineitem)",
    "fr": "fr AS (SELECT 'E' AS stream_id, vec_id::BIGINT AS seq, (vec_id + 3*(vec_id//100))::BIGINT AS packet_counter, (label=9)::INT AS packet_error, label, [round(embedding[2*t+1]::DOUBLE*1048576)::INT for t in range(32)] AS i, [round(embedding[2*t+2]::DOUBLE*1048576)::INT for t in range(32)] AS q FROM embeddings)",
    "v": "v AS (SELECT user_id AS stream_id, event_id AS seq, event_id AS packet_counter, (event_type='error')::INT AS packet_error, (event_type='click')::INT AS flag0, ts FROM events)",
    "p": "p AS (SELECT p_brand AS tone_set, p_partkey AS tone, p_retailprice::DOUBLE*1e6 + p_partkey AS freq_hz, p_size/50.0::DOUBLE AS amplitude FROM part)",
    "s": "s AS (SELECT s_suppkey AS o, 8.5e8 + s_suppkey*1.5e6 AS cf, s_acctbal::DOUBLE/1e4 AS cv FROM supplier)",
    "sn": "sn AS (SELECT l_returnflag AS run, l_linestatus AS dac, round((l_quantity::DOUBLE-25)*1400)::INT AS i, round(l_discount::DOUBLE*-330000)::INT AS q FROM lineitem)",
}
