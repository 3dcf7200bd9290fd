"""Converter saturation and filterbank overflow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def saturation(snapshot: DataFrame, *keys: str, bits: int = 16, clk_hz: float = 2048e6, headroom_lsb: int = 0) -> DataFrame:
    """Extremes of i and q over full scale, whether any reaches it, and seconds integrated. headroom_lsb counts values
    so near to the top as saturated: the largest positive word is one below full scale."""
    scale, top = float(2 ** (bits - 1)), 1 - headroom_lsb / float(2 ** (bits - 1))
    out = snapshot.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for n, f in (("max", F.max), ("min", F.min)) for c in ("i", "q")], (F.count("*") / clk_hz).alias("integration_s"))
    out = out.withColumns({c: F.col(c) / scale for c in ("max_i", "max_q", "min_i", "min_q")})
    return out.withColumn("saturated", (F.greatest("max_i", "max_q") >= top) | (F.least("min_i", "min_q") <= -1))


def any_saturated(by_converter: DataFrame, *keys: str) -> DataFrame:
    return by_converter.groupBy(*keys).agg(F.bool_or("saturated").alias("saturated"))


def overflow(counters: DataFrame, order: str = "ts") -> DataFrame:
    """Change of each block's count from its first to its last reading, by board."""
    ends = counters.groupBy("board", "block").agg(F.max_by("count", order).alias("b"), F.min_by("count", order).alias("a"))
    return ends.select("board", "block", (F.col("b") - F.col("a")).alias("delta"), (F.col("b") != F.col("a")).alias("overflowed"))


def overflow_sides(deltas: DataFrame, tx: tuple[str, ...] = ("psb", "psbscale"), rx: tuple[str, ...] = ("pfb",)) -> DataFrame:
    some = lambda blocks: F.coalesce(F.bool_or(F.col("overflowed") & F.col("block").isin(*blocks)), F.lit(False))
    return deltas.groupBy("board").agg(some(tx).alias("tx_overflow"), some(rx).alias("rx_overflow"), F.bool_or("overflowed").alias("any_overflow"))
