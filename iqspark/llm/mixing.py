"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialize

#: Sources whose rates are broadcast at most; beyond that the join is left to the optimiser, which splits hot keys.
MOST_BROADCAST = 100_000
#: Windows that rows of one key are dealt to, and bytes of text of an output partition, about.
SALTS, PART_BYTES = 1024, 128_000_000


def hashed_uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of md5 of the seed and parts: the same on every engine and at every size."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, smoothing: float = 0.5, size: float = 1.0) -> DataFrame:
    """(source, n, bytes, rate): the mean number of copies of each document of a source, so that sources have the target shares
    of size times the present rows. Without weights, shares are in proportion to n ** smoothing. Sources that weights
    doesn't name get rate 0; a null source is a source of its own."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 64).alias("bytes"))
    if weights is None:
        counts = counts.withColumn("w", F.pow("n", F.lit(float(smoothing))))
    else:
        named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        counts = counts.withColumn("w", F.coalesce(named[F.col("source")], F.lit(0.0)))
    total = counts.agg(F.sum("w").alias("sw"), F.sum("n").alias("sn"))
    return counts.join(F.broadcast(total)).select("source", "n", "bytes", F.try_divide(F.col("w") * F.col("sn") * float(size), F.col("sw") * F.col("n")).alias("rate"))


def with_cumulative(rates: DataFrame) -> DataFrame:
    """Adds cdf: P(X <= k) of a Poisson variable of the rate for k = 0 to rate + 12 * sqrt(rate) + 20; null for rate 0."""
    at = rates.where("rate > 0").select("rate").distinct().withColumn("k", F.explode(F.expr("sequence(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS INT))")))
    order = Window.partitionBy("rate").orderBy("k")
    logs = F.sum(F.when(F.col("k") > 0, F.ln(F.col("rate") / F.col("k"))).otherwise(0.0)).over(order)
    each = at.withColumn("p", F.exp(-F.col("rate") + logs)).withColumn("c", F.sum("p").over(order))
    cdf = each.groupBy(F.col("rate").alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))
    return rates.join(cdf, F.col("rate") == F.col("r"), "left").drop("r")


def numbered_copies(docs: DataFrame, key: str, occurrence: str) -> DataFrame:
    """docs with occurrence: 1, 2, ... among the rows of one key, in any order; 1 for all others. Only rows of repeated
    keys are moved, and those of one key to SALTS windows: a small table with a row for each key and salt joins them."""
    repeats = bounded(docs.groupBy(key).count().where("count > 1").select(key), "repeats")
    once = docs.join(repeats, key, "left_anti").withColumn(occurrence, F.lit(1).cast("long"))
    again = docs.join(repeats, key, "left_semi").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    again = again.withColumn("__k", F.row_number().over(Window.partitionBy(key, "__salt").orderBy(F.lit(0))))
    again = materialize(again, "again")
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    salts = again.groupBy(key, "__salt").agg(F.count("*").alias("__n")).withColumn("__before", before).drop("__n")
    again = again.join(bounded(salts, "salts"), [key, "__salt"]).withColumn(occurrence, F.col("__k") + F.col("__before"))
    return once.unionByName(again.select(*once.columns))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, smoothing: float = 0.5, size: float = 1.0, seed: str = "mix", copy: str = "copy", position: str = "position") -> DataFrame:
    """Every row of docs as often as a Poisson variable says whose mean is its source's rate (source_rates), in an order
    that mixes all rows: the columns of docs, then copy (1, 2, ...) and position (a hash; rows are sorted by it).

    A row's number inverts the Poisson distribution at a uniform number hashed from seed, doc_id, text and occurrence:
    the least k with u <= P(X <= k). Occurrence numbers the rows that have one doc_id and text, so that rows without a
    doc_id, and repeated rows, are drawn each for itself, and their copies are spread like all others. It depends on no
    other row but through the rate. A null doc_id or text hashes as an empty one, a null source has its own rate.
    Columns of docs with the names of copy and position are replaced; give other names to keep them. Sources of one row
    or of a third of all rows are alike: counts combine in map tasks, and the rates (one row for each source) are
    broadcast after a check of their number. The number of partitions follows the bytes expected.
    """
    docs = docs.drop(copy, position)
    names = docs.columns
    rates = bounded(with_cumulative(source_rates(docs, weights, smoothing, size)).select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), F.col("cdf").alias("__cdf"), F.expr("rate * bytes").alias("__bytes")), "rates", MOST_BROADCAST)
    expected = rates.agg(F.sum("__bytes")).first()[0] or 0
    keyed = docs.withColumns({"__text": F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    keyed = numbered_copies(keyed.withColumn("__row", F.xxhash64("doc_id", "__text")), "__row", "__nth")
    row = [F.col("doc_id"), F.col("__text"), F.col("__nth")]
    out = keyed.join(rates, keyed["source"].eqNullSafe(F.col("__source"))).withColumn("__u", hashed_uniform(seed, *row))
    out = out.withColumn("__k", F.when(F.col("__rate") > 0, F.expr("size(filter(__cdf, c -> c < __u))")).otherwise(0)).where("__k > 0")
    out = out.withColumn(copy, F.explode(F.expr("sequence(1, __k)")))
    out = out.withColumn(position, hashed_uniform(seed + "/order", *row, F.col(copy)))
    out = out.select(*[f"`{c}`" for c in names], copy, position)
    # Positions are uniform, so equal ranges of them are equal shares: no look at the data is needed to cut them.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(expected // PART_BYTES) + 1)
    return out.repartitionById(parts, F.floor(F.col(position) * parts).cast("int")).sortWithinPartitions(position)
