"""Frames of a recording: samples, time axes, flags, continuity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FLAG_NAMES
from .epochs import COUNTER, MOST_STEP, RANGE, with_epochs


def first_tones(frames: DataFrame, n: int) -> DataFrame:
    return frames.withColumns({"i": F.slice("i", 1, n), "q": F.slice("q", 1, n)})


def to_samples(frames: DataFrame) -> DataFrame:
    """One row for each tone and frame; prune tones before."""
    return frames.select("stream_id", "seq", "packet_counter", F.posexplode(F.arrays_zip("i", "q")).alias("tone", "z")).select("stream_id", "seq", "packet_counter", "tone", "z.i", "z.q")


def to_frames(samples: DataFrame) -> DataFrame:
    """Samples back to arrays in tone order."""
    z = F.array_sort(F.collect_list(F.struct("tone", "i", "q")))
    return samples.groupBy("stream_id", "seq", "packet_counter").agg(z.alias("z")).select("stream_id", "seq", "packet_counter", F.col("z.i").alias("i"), F.col("z.q").alias("q"))


def to_wide(samples: DataFrame, tones: list[int]) -> DataFrame:
    """Columns i_0000, q_0000, ... of the given tones."""
    return samples.groupBy("stream_id", "seq", "packet_counter").agg(*[F.max(F.when(F.col("tone") == t, F.col(c))).alias(f"{c}_{t:04d}") for t in tones for c in ("i", "q")])


def tone_series(frames: DataFrame, tone: int) -> DataFrame:
    """One tone's values without exploding the rest."""
    return frames.select("stream_id", "seq", "packet_counter", F.get("i", F.lit(tone)).alias("i"), F.get("q", F.lit(tone)).alias("q"))


def take_samples(frames: DataFrame, first: int, n: int) -> DataFrame:
    return frames.where(F.col("seq").between(first, first + n - 1))


def index_time(frames: DataFrame, rate: float) -> DataFrame:
    return frames.withColumn("t", F.col("seq") / rate)


def counter_time(frames: DataFrame, rate: float, most_step: int = MOST_STEP) -> DataFrame:
    """Adds t, seconds since the first frame of the stream's epoch, by its counter (right for triggered streams too), over
    any number of wraps; a restarted counter begins at 0 anew (with_epochs has its number)."""
    return with_epochs(frames, most_step).withColumn("t", F.col("rebased") / rate).drop("epoch", "counter64", "rebased")


def named_flags(frames: DataFrame) -> DataFrame:
    return frames.withColumns({name: F.get("flags", F.lit(k)) for k, name in enumerate(FLAG_NAMES)})


def counter_steps(frames: DataFrame, bucket: int | None = RANGE) -> DataFrame:
    """Adds prev_counter, step (as stored) and step_mod (modulo 2**32) from the frame before, in order of seq.

    No task holds a whole stream: frames are windowed in ranges of bucket values of seq, and the first frame of a range
    gets its predecessor from a join with the last frames of the ranges before it.
    """
    part = frames.withColumn("b", F.floor(F.col("seq") / (bucket or RANGE)))
    lasts = part.groupBy("stream_id", "b").agg(F.max_by("packet_counter", "seq").alias("last"))
    # One row for each range: a window over a stream's ranges is small, and ranges may be empty.
    lasts = lasts.withColumn("before", F.lag("last").over(Window.partitionBy("stream_id").orderBy("b"))).drop("last")
    prev = F.lag("packet_counter").over(Window.partitionBy("stream_id", "b").orderBy("seq"))
    out = part.withColumn("inner", prev).join(lasts, ["stream_id", "b"]).withColumn("prev_counter", F.coalesce("inner", "before")).drop("inner", "before", "b")
    step = F.col("packet_counter") - F.col("prev_counter")
    return out.withColumns({"step": step, "step_mod": F.pmod(step, F.lit(COUNTER))})


def continuity(frames: DataFrame, bucket: int | None = RANGE, most_step: int = MOST_STEP) -> DataFrame:
    """Per stream: frames, whether every counter follows the one before, and how many are missing. A step over most_step
    is a restart, after which nothing is known to be missing; n_restarts counts them."""
    steps = counter_steps(frames, bucket).withColumn("again", F.coalesce(F.col("step_mod") > most_step, F.lit(False)))
    missing = F.sum(F.when(~F.col("again") & (F.col("step_mod") > 0), F.col("step_mod") - 1))
    return steps.groupBy("stream_id").agg(F.count("*").alias("n_frames"), F.coalesce(F.bool_and(F.col("step_mod") == 1), F.lit(True)).alias("contiguous"), F.coalesce(missing, F.lit(0)).alias("n_missing"), F.count_if("again").alias("n_restarts"))


def rebased_counter(frames: DataFrame, most_step: int = MOST_STEP) -> DataFrame:
    """Adds rebased, the counter less that of the first frame of the stream's epoch, over any number of wraps."""
    return with_epochs(frames, most_step).drop("epoch", "counter64")


def error_count(frames: DataFrame) -> DataFrame:
    return frames.groupBy("stream_id").agg(F.sum(F.when(F.col("packet_error") != 0, 1).otherwise(0)).alias("n_errors"))


def running_errors(frames: DataFrame, bucket: int = 65_536) -> DataFrame:
    """Adds n_errors, frames with an error up to each one. Frames are windowed in ranges of bucket values of seq; errors
    of the ranges before come from one row for each range."""
    error = F.when(F.col("packet_error") != 0, 1).otherwise(0)
    part = frames.withColumn("b", F.floor(F.col("seq") / bucket))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("stream_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = part.groupBy("stream_id", "b").agg(F.sum(error).alias("s")).select("stream_id", "b", before.alias("before"))
    own = F.sum(error).over(Window.partitionBy("stream_id", "b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("own", own).join(sums, ["stream_id", "b"]).withColumn("n_errors", F.col("before") + F.col("own")).drop("own", "before", "b")


def flag_intervals(frames: DataFrame, flag: int | None = None, bucket: int = 65_536) -> DataFrame:
    """Runs of a flag's value: stream_id, flag, value, first and last seq, frames; of every flag if none is named.

    Changes are found within ranges of bucket values of seq; one row for each range (its last value and its number of
    changes) gives the value before it and the number of its first run, so no task holds a whole stream.
    """
    state = frames.select("stream_id", "seq", F.floor(F.col("seq") / bucket).alias("b"), F.posexplode("flags").alias("flag", "value"))
    if flag is not None:
        state = state.where(F.col("flag") == flag)
    keys = ["stream_id", "flag"]
    order = Window.partitionBy(*keys, "b").orderBy("seq")
    inner = state.withColumns({"opens": F.lag(F.lit(False), 1, True).over(order), "prev": F.lag("value").over(order)})
    inner = inner.withColumn("change", F.when(~F.col("opens") & ~F.col("prev").eqNullSafe(F.col("value")), 1).otherwise(0))
    inner = inner.withColumn("own", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("prev", "opens")
    ends = inner.groupBy(*keys, "b").agg(F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last"), F.sum("change").alias("c"))
    ranges = Window.partitionBy(*keys).orderBy("b")
    same = F.lag(F.lit(False), 1, True).over(ranges) | F.lag("last").over(ranges).eqNullSafe(F.col("first"))
    ends = ends.withColumn("seam", F.when(same, 0).otherwise(1))
    base = F.sum("seam").over(ranges) + F.coalesce(F.sum("c").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = inner.join(ends.select(*keys, "b", base.alias("base")), [*keys, "b"]).withColumn("run", F.col("base") + F.col("own"))
    return runs.groupBy(*keys, "run", "value").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_frames")).drop("run")


#: Headers that are broadcast at most; beyond that they are joined by a shuffle.
MOST_HEADERS = 100_000


def with_header(rows: DataFrame, headers: DataFrame, *keys: str) -> DataFrame:
    """Frames or sweep rows with their header's columns (sample_rate, acc_len, shifts and what else it has), one header for
    each stream_id (or keys): of several the one whose JSON text comes first. A header's columns take the place of equally
    named ones. Rows without a header keep nulls."""
    keys = keys or ("stream_id",)
    more = [c for c in headers.columns if c not in keys]
    all_of_it = F.struct(*more) if more else F.struct(*keys)
    headers = headers.groupBy(*keys).agg(F.min_by(all_of_it, F.to_json(all_of_it)).alias("x")).select(*keys, *[F.col("x")[c].alias(c) for c in more])
    few = headers.select(*keys).limit(MOST_HEADERS + 1).count() <= MOST_HEADERS
    return rows.drop(*more).join(F.broadcast(headers) if few else headers, [*keys], "left")


def receive_rate(packets: DataFrame) -> DataFrame:
    """Count, seconds from first to last and rate of packets(stream_id, ts)."""
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return packets.groupBy("stream_id").agg(F.count("*").alias("n"), (span / 1e6).alias("elapsed_s")).withColumn("rate_hz", F.try_divide(F.col("n"), F.col("elapsed_s")))


def differences(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per table pair: rows, and rows that differ or are on one side only (exported against imported data). Rows that repeat
    a key are compared as often as they are there: of a key's rows on the larger side, those with an equal partner agree."""
    x = F.struct(*values).alias("x")
    both = a.select(*keys, x, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*keys, x, F.lit(0).alias("a"), F.lit(1).alias("b")))
    rows = both.groupBy(*keys, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    each = rows.groupBy(*keys).agg(F.greatest(F.sum("a"), F.sum("b")).alias("n"), F.sum(F.least("a", "b")).alias("same"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") - F.col("same")), F.lit(0)).alias("n_different")).withColumn("equal", F.col("n_different") == 0)
