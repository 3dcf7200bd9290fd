"""Counters of 32 bits as one growing number: wraps are carried on, restarts begin a new epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a 32-bit counter.
COUNTER = 2**32
#: The largest step, modulo COUNTER, that is a gap; a larger one is a restart. About 9 hours at 500 frames a second.
MOST_STEP = 2**24
#: Values of seq in a range of a stream, which is what a task windows at once.
RANGE = 65_536


def restarts(counter: Column, before: Column, most_step: int) -> Column:
    """Whether a counter does not go on from the one before; false if there is none."""
    return F.coalesce(F.pmod(counter - before, F.lit(COUNTER)) > most_step, F.lit(False))


def with_epochs(frames: DataFrame, most_step: int = MOST_STEP, bucket: int = RANGE) -> DataFrame:
    """Adds epoch (0, 1, ...: restarts of the stream so far), counter64 (the counter, with 2**32 more for each wrap in the
    epoch) and rebased (counter64 less that of the epoch's first frame) to frames(stream_id, seq, packet_counter), in order
    of seq.

    A step of at most most_step modulo 2**32 goes on (0 repeats a counter, a falling counter has wrapped), a larger one is
    a restart. Frames are windowed in ranges of bucket values of seq. A range is summed up in one row (first and last
    counter, restarts, wraps and first counter of its last epoch), and a scan over a stream's rows, segmented by restarts,
    gives what each range goes on from; so a stream may be of any length. A null packet_counter is an error of the input
    and gives nulls in its epoch.
    """
    part = frames.withColumn("__b", F.floor(F.col("seq") / bucket))
    order = Window.partitionBy("stream_id", "__b").orderBy("seq")
    c = F.col("packet_counter")
    inner = part.withColumn("__prev", F.lag("packet_counter").over(order))
    again = restarts(c, F.col("__prev"), most_step)
    inner = inner.withColumns({"__again": again.cast("long"), "__wrap": (~again & (c < F.col("__prev"))).cast("long")})
    inner = inner.withColumn("__epoch", F.sum("__again").over(order))
    epoch = Window.partitionBy("stream_id", "__b", "__epoch").orderBy("seq")
    inner = inner.withColumns({"__wraps": F.sum(F.coalesce("__wrap", F.lit(0))).over(epoch), "__start": F.first("packet_counter").over(epoch)}).drop("__prev", "__again", "__wrap")
    last = {k: F.max_by(v, "seq").alias(k) for k, v in (("last", "packet_counter"), ("epochs", "__epoch"), ("tail_wraps", "__wraps"), ("tail_start", "__start"))}
    ranges = inner.groupBy("stream_id", "__b").agg(F.min_by("packet_counter", "seq").alias("first"), *last.values())
    ranges = range_starts(ranges, most_step)
    out = inner.join(ranges, ["stream_id", "__b"])
    head = F.col("__epoch") == 0  # goes on from the ranges before
    wraps = F.when(head, F.col("__wraps") + F.col("carried")).otherwise(F.col("__wraps"))
    start = F.when(head, F.col("start")).otherwise(F.col("__start"))
    counter64 = c.cast("long") + wraps * COUNTER
    return out.select(*[F.col(f"`{x}`") for x in frames.columns], (F.col("__epoch") + F.col("base")).alias("epoch"), counter64.alias("counter64"), (counter64 - start).alias("rebased"))


def range_starts(ranges: DataFrame, most_step: int) -> DataFrame:
    """(stream_id, __b, base, carried, start) of ranges(stream_id, __b, first, last, epochs, tail_wraps, tail_start): epochs
    before the range's first one, wraps of that epoch before the range, and its first counter."""
    order = Window.partitionBy("stream_id").orderBy("__b")
    before = {f"{x}_": F.lag(x).over(order) for x in ("last", "epochs", "tail_wraps", "tail_start")}
    seam = ranges.withColumns(before)
    again = restarts(F.col("first"), F.col("last_"), most_step)
    seam = seam.withColumns({"again": again, "wrapped": (~again & F.coalesce(F.col("first") < F.col("last_"), F.lit(False))).cast("long")})
    fresh = F.col("again") | F.col("last_").isNull()
    seam = seam.withColumns({
        "base": F.coalesce(F.sum("epochs_").over(order), F.lit(0)) + F.sum(F.col("again").cast("long")).over(order),
        "resets": (fresh | (F.col("epochs_") > 0)).cast("long"),
        "adds": F.when(fresh, 0).otherwise(F.col("tail_wraps_") + F.col("wrapped")),
        "mark": F.when(fresh, F.col("first")).when(F.col("epochs_") > 0, F.col("tail_start_")),
    })
    seam = seam.withColumns({"segment": F.sum("resets").over(order), "start": F.last("mark", ignorenulls=True).over(order)})
    carried = F.sum("adds").over(Window.partitionBy("stream_id", "segment").orderBy("__b"))
    return seam.withColumn("carried", carried).select("stream_id", "__b", "base", "carried", "start")


def epoch_ranges(frames: DataFrame) -> DataFrame:
    """(stream_id, epoch, first_seq, last_seq, n_frames, n_steps) of with_epochs: n_steps is how far the counter went, so an
    epoch without gaps has n_frames - 1."""
    return frames.groupBy("stream_id", "epoch").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_frames"), F.max("rebased").alias("n_steps"))
