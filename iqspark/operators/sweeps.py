"""Frequency sweeps: plans, responses, resonances and spectra."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iq
from ..functions.frequency import sweep_frequency
from ..functions.hashed import hashed_uniform
from ..sources.shared import stored


def grid(tones: DataFrame, points: int, direction: str = "up", default_span: float | None = None) -> DataFrame:
    """Every tone at every point: tones(tone, centre_hz[, span_hz]); a tone without a span takes default_span."""
    span = F.coalesce("span_hz", F.lit(default_span)) if "span_hz" in tones.columns else F.lit(default_span)
    span = F.when(span.isNull(), F.raise_error("a tone has no span").cast("double")).otherwise(span)
    out = tones.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return out.withColumn("f", sweep_frequency(F.col("centre_hz"), span.cast("double"), F.col("point"), points, direction))


def response(samples: DataFrame, drop_errors: bool = False) -> DataFrame:
    """Mean and population deviation over the samples of each (sweep_id, tone, point)."""
    kept = samples.where("coalesce(packet_error, 0) = 0") if drop_errors else samples
    return kept.groupBy("sweep_id", "tone", "point").agg(F.avg("i").alias("i"), F.avg("q").alias("q"), F.stddev_pop("i").alias("ei"), F.stddev_pop("q").alias("eq"), F.count("*").alias("n"))


def landed_bitmaps(samples: DataFrame, points: int, tones: int) -> DataFrame:
    """(sweep_id, bucket, bits): the (tone, point) places of samples as bitmaps, one row for each 32,768 places. They merge
    (merge_bitmaps) over batches, files and streams, and repeated samples change nothing."""
    place = F.col("tone").cast("long") * points + F.col("point") + 1  # buckets and bits begin at 1
    inside = samples.where(F.col("point").between(0, points - 1) & F.col("tone").between(0, tones - 1))
    return inside.groupBy("sweep_id", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def merge_bitmaps(*bitmaps: DataFrame) -> DataFrame:
    every = bitmaps[0]
    for more in bitmaps[1:]:
        every = every.unionByName(more)
    return every.groupBy("sweep_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def landed(bitmaps: DataFrame, points: int, tones: int) -> DataFrame:
    """Per sweep: places that have landed, their share of all, and whether the sweep is complete."""
    n = F.sum(F.bitmap_count("bits"))
    return bitmaps.groupBy("sweep_id").agg(n.alias("n_landed"), (n / (points * tones)).alias("share"), (n == points * tones).alias("complete"))


def missing_places(bitmaps: DataFrame, points: int, tones: int) -> DataFrame:
    """(sweep_id, tone, point) that have not landed, of sweeps of which something has. Each bucket (numbered from 1) says so
    by itself; those without a bitmap lack all their places."""
    size, total = 8 * 4096, points * tones
    buckets = bitmaps.select("sweep_id").distinct().select("sweep_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit((total - 1) // size + 1).cast("long"))).alias("bucket"))
    each = buckets.join(bitmaps, ["sweep_id", "bucket"], "left")
    place = F.explode(F.sequence((F.col("bucket") - 1) * size, F.least(F.col("bucket") * size, F.lit(total)) - 1)).alias("place")
    bit = F.expr("coalesce(shiftright(cast(conv(hex(substring(bits, (place % 32768) div 8 + 1, 1)), 16, 10) AS int), cast(place % 8 AS int)) & 1, 0)")
    return each.select("sweep_id", "bits", place).where(bit == 0).select("sweep_id", F.expr(f"cast(place div {points} AS int)").alias("tone"), F.expr(f"cast(place % {points} AS int)").alias("point"))


def completeness(samples: DataFrame, points: int) -> DataFrame:
    """Progress and number of points that have landed, by sweep."""
    bits = samples.groupBy("sweep_id", F.bitmap_bucket_number("point").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("point")).alias("bits"), F.max("point").alias("last"))
    return bits.groupBy("sweep_id").agg(F.try_divide(F.max("last"), F.lit(points - 1)).alias("progress"), F.sum(F.bitmap_count("bits")).alias("n_points"))


def missing_points(samples: DataFrame, plan: DataFrame) -> DataFrame:
    return plan.select("sweep_id", "tone", "point").join(samples, ["sweep_id", "tone", "point"], "left_anti")


#: Values of a counter in a bucket of the join of frames with their points.
COUNTERS = 4096


def samples_of_points(frames: DataFrame, points: DataFrame) -> DataFrame:
    """Sweep samples of a recording: frames(stream_id, counter64, packet_error, i, q) whose counter is in a range of
    points(sweep_id, stream_id, point, first_counter, last_counter); sample is the place in the range.

    An interval join by equal keys: ranges are cut at the borders of buckets of COUNTERS values, so no frame meets points
    of other buckets, and neither a long dwell nor a long recording makes a hot key. A frame in several ranges (of one
    sweep or several) is a sample of each; one in none is left out.
    """
    cut = points.withColumn("bucket", F.explode(F.expr(f"sequence(first_counter div {COUNTERS}, last_counter div {COUNTERS})")))
    keyed = frames.withColumn("bucket", F.expr(f"counter64 div {COUNTERS}"))
    met = keyed.join(cut, ["stream_id", "bucket"]).where(F.col("counter64").between(F.col("first_counter"), F.col("last_counter")))
    each = met.select("sweep_id", (F.col("counter64") - F.col("first_counter")).cast("int").alias("sample"), "point", "packet_error", F.posexplode(F.arrays_zip("i", "q")).alias("tone", "z"))
    return each.select("sweep_id", "sample", "point", "tone", F.col("z.i").cast("double").alias("i"), F.col("z.q").cast("double").alias("q"), "packet_error")


def with_accumulations(samples: DataFrame, accumulations: DataFrame) -> DataFrame:
    """Raw samples (sweep_id, sample, point, tone, i, q) with packet_counter and packet_error of their accumulation, from
    accumulations(sweep_id, sample, point, acc_count, acc_err); samples without one have null, which drop_errors keeps."""
    few = accumulations.select("sweep_id").limit(MOST_ACCUMULATIONS + 1).count() <= MOST_ACCUMULATIONS
    of = accumulations.select("sweep_id", "sample", "point", F.col("acc_count").alias("packet_counter"), F.col("acc_err").alias("packet_error"))
    return samples.drop("packet_counter", "packet_error").join(F.broadcast(of) if few else of, ["sweep_id", "sample", "point"], "left")


#: Accumulations that are broadcast at most; beyond that they are joined by a shuffle.
MOST_ACCUMULATIONS = 500_000


def with_gradient(sweep: DataFrame) -> DataFrame:
    """Adds grad, the size of dz by index: central inside, one-sided at the ends; 0 for a single point."""
    order = Window.partitionBy("sweep_id", "tone").orderBy("point")
    parts = []
    for c in ("i", "q"):
        before, after, x = F.lag(c).over(order), F.lead(c).over(order), F.col(c)
        parts.append(F.coalesce((after - before) / 2, after - x, x - before, F.lit(0.0)))
    return sweep.withColumn("grad", F.hypot(*parts))


def retune(sweep: DataFrame, method: str = "max_gradient") -> DataFrame:
    """Resonance of each tone: the frequency at the first largest gradient, or at the first least magnitude. method is
    the default; a column named method, if there is one, has it for each tone."""
    chosen = F.coalesce("method", F.lit(method)) if "method" in sweep.columns else F.lit(method)
    mag = F.hypot("i", "q")
    out = with_gradient(sweep).groupBy("sweep_id", "tone").agg(
        F.min(chosen).alias("method"),
        F.max_by("f", F.struct("grad", -F.col("point"))).alias("f_grad"),
        F.min_by(F.when(~F.isnan(mag), F.col("f")), F.struct(F.isnan(mag).alias("nan"), mag.alias("mag"), F.col("point"))).alias("f_min"),
    )
    bad = F.raise_error(F.concat(F.lit("unknown retune method "), F.col("method"))).cast("double")
    return out.withColumn("f_resonance", F.when(F.col("method") == "max_gradient", F.col("f_grad")).when(F.col("method") == "min_mag", F.col("f_min")).otherwise(bad))


def restore_frequencies(current: DataFrame, centres: DataFrame) -> DataFrame:
    """After a sweep: a tone keeps its frequency within centre +- span / 2, else takes the centre; all take centres if
    the numbers of tones differ. current(tone, freq_hz), centres(tone, centre_hz, span_hz)."""
    same = current.agg(F.count("*").alias("a")).join(F.broadcast(centres.agg(F.count("*").alias("b"))))
    joined = centres.join(current, "tone", "left").join(F.broadcast(same))
    inside = F.col("freq_hz").between(F.col("centre_hz") - F.col("span_hz") / 2, F.col("centre_hz") + F.col("span_hz") / 2)
    return joined.select("tone", F.when((F.col("a") == F.col("b")) & inside, F.col("freq_hz")).otherwise(F.col("centre_hz")).alias("freq_hz"))


def zoom(spectrum: DataFrame, low: float, high: float) -> DataFrame:
    """Least and largest log magnitude and phase strictly between two frequencies, by sweep."""
    cut = spectrum.where((F.col("f") > low) & (F.col("f") < high))
    mag, phase = iq.log_magnitude(F.col("i"), F.col("q")), iq.angle(F.col("i"), F.col("q"))
    return cut.groupBy("sweep_id").agg(F.min(mag).alias("min_db"), F.max(mag).alias("max_db"), F.min(phase).alias("min_phase"), F.max(phase).alias("max_phase"))


def flip_odd_bins(sweep: DataFrame, **grid_settings) -> DataFrame:
    i, q = iq.flip_odd_bins(F.col("i"), F.col("q"), F.col("f"), **grid_settings)
    return sweep.withColumns({"i": i, "q": q})


def _wraps(phase: Column, before: Column) -> Column:
    d = phase - before
    return F.when(d > math.pi, -1).when(d < -math.pi, 1).otherwise(0)


#: Rows of a range, about: what one window of an unwrapped sweep holds.
RANGE_ROWS = 65_536


def in_ranges(sweep: DataFrame, order: tuple[str, ...] = ("f", "tone", "point"), rows: int = RANGE_ROWS) -> DataFrame:
    """sweep with part: ranges of about so many rows in the order of (sweep_id, *order), numbered in that order, written to
    the shared folder. Overlapping tones and tones of any size are one order, and no range holds a whole sweep."""
    parts = max(1, -(-sweep.count() // rows))
    return stored(sweep.repartitionByRange(parts, "sweep_id", *order).withColumn("part", F.spark_partition_id()), "ranges")


def unwrap(sweep: DataFrame, order: tuple[str, ...] = ("tone", "point"), rows: int = RANGE_ROWS) -> DataFrame:
    """Adds phase (wrapped) and uphase: each step over half a turn adds whole turns, in the order of a sweep: by tone and
    point, or by ("f", "tone", "point"); in ranges of about so many rows."""
    return unwrap_tones(in_ranges(sweep, order, rows), "part", order).drop("part")


def unwrap_tones(sweep: DataFrame, segment: str = "tone", order: tuple[str, ...] = ("point",)) -> DataFrame:
    """unwrap for one huge sweep: no task holds more than one tone, or another segment (in_ranges) with its inner order.

    Turns are whole numbers, so they add up in any grouping: each segment unwraps by itself, one row for each segment (its
    first and last phase and its turns) gives the turns before it, and these are joined back.
    """
    w = Window.partitionBy("sweep_id", segment).orderBy(*order)
    place = F.struct(*order)
    out = sweep.withColumn("phase", iq.angle(F.col("i"), F.col("q"))).withColumn("k", F.coalesce(_wraps(F.col("phase"), F.lag("phase").over(w)), F.lit(0)))
    out = out.withColumn("own", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = out.groupBy("sweep_id", segment).agg(F.min_by("phase", place).alias("a"), F.max_by("phase", place).alias("b"), F.sum("k").alias("turns"))
    segments = Window.partitionBy("sweep_id").orderBy(segment)
    seam = _wraps(F.col("a"), F.lag("b").over(segments))
    before = ends.withColumn("seam", seam).withColumn("add", F.sum(F.col("seam")).over(segments.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("turns").over(segments.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = out.join(before.select("sweep_id", segment, "add"), ["sweep_id", segment])
    return joined.withColumn("uphase", F.col("phase") + (F.col("own") + F.col("add")) * iq.TAU).drop("k", "own", "add")


def phase_slope(unwrapped: DataFrame, segment: str = "tone", order: tuple[str, ...] = ("point",)) -> DataFrame:
    """Adds slope, d uphase / d f on uneven steps (second order inside, first at a sweep's ends); null where steps are 0.
    Points follow each other by tone and point, or by another segment (in_ranges) and its inner order. No task holds more
    than one segment: the points beside its ends come from one row for each segment."""
    w = Window.partitionBy("sweep_id", segment).orderBy(*order)
    z, place = F.struct("f", "uphase"), F.struct(*order)
    ends = unwrapped.groupBy("sweep_id", segment).agg(F.min_by(z, place).alias("first"), F.max_by(z, place).alias("last"))
    segments = Window.partitionBy("sweep_id").orderBy(segment)
    beside = ends.select("sweep_id", segment, F.lag("last").over(segments).alias("from"), F.lead("first").over(segments).alias("to"))
    out = unwrapped.withColumns({"before": F.lag(z).over(w), "after": F.lead(z).over(w)}).join(beside, ["sweep_id", segment])
    before, after = F.coalesce("before", "from"), F.coalesce("after", "to")
    f, p = F.col("f"), F.col("uphase")
    hs, hd = f - before["f"], after["f"] - f
    inner = F.try_divide(hs * hs * after["uphase"] + (hd * hd - hs * hs) * p - hd * hd * before["uphase"], hs * hd * (hd + hs))
    edge = F.coalesce(F.try_divide(after["uphase"] - p, hd), F.try_divide(p - before["uphase"], hs))
    return out.withColumn("slope", F.when(hs.isNull() | hd.isNull(), edge).otherwise(inner)).drop("before", "after", "from", "to")


def frequency_slopes(sweep: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """phase, uphase and slope of a sweep flattened in order of frequency, however its tones overlap."""
    order = ("f", "tone", "point")
    ranged = in_ranges(sweep, order, rows)
    return phase_slope(unwrap_tones(ranged, "part", order), "part", order).drop("part")


#: Rank error of the approximate quantiles that bracket a median: one in so many.
_ACCURACY = 10_000
MOST_SWEEPS = 100_000


def median_slope(slopes: DataFrame) -> DataFrame:
    """Exact median over a sweep's points; NaN and null don't count.

    Slopes are computed once, to the shared folder. Two approximate quantiles (mergeable sketches with a bound on their
    rank error) bracket the median. In one more pass, values below the bracket are counted in one row, and those within
    it, about 4 in 10,000, are counted by value in map tasks; the median is where the running count passes the middle.
    So no task holds a sweep's slopes, and equal ones are one row.
    """
    ok = stored(slopes.where(F.col("slope").isNotNull() & ~F.isnan("slope")).select("sweep_id", "slope"), "slopes")
    low, high = 0.5 - 2 / _ACCURACY, 0.5 + 2 / _ACCURACY
    marks = stored(ok.groupBy("sweep_id").agg(F.percentile_approx("slope", [low, high], _ACCURACY).alias("q"), F.count("*").alias("n")), "marks")
    near = ok.join(F.broadcast(marks) if marks.count() <= MOST_SWEEPS else marks, "sweep_id").where(F.col("slope") <= F.col("q")[1])
    value = F.when(F.col("slope") >= F.col("q")[0], F.col("slope")).alias("value")
    counts = near.groupBy("sweep_id", "n", value).agg(F.count("*").alias("c"))
    order = Window.partitionBy("sweep_id").orderBy(F.asc_nulls_first("value"))
    ranked = counts.withColumn("up_to", F.sum("c").over(order))
    at = lambda rank: (F.col("up_to") - F.col("c") < rank) & (F.col("up_to") >= rank)
    middle = [F.max(F.when(at(rank), F.col("value"))) for rank in (F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)]
    return ranked.groupBy("sweep_id").agg(((middle[0] + middle[1]) / 2).alias("median_slope"))


def remove_slope(sweep: DataFrame, slopes: DataFrame, half_turn: bool = True) -> DataFrame:
    """z exp(-j (slope f + pi)); half_turn=False leaves pi out. slopes: one row for each sweep."""
    joined = sweep.join(slopes, "sweep_id", "left")
    theta = F.coalesce("median_slope", F.lit(0.0)) * F.col("f") + (math.pi if half_turn else 0.0)
    i, q = iq.rotate(F.col("i"), F.col("q"), theta)
    return joined.withColumns({"i": i, "q": q}).drop("median_slope")


def spectrum(sweep: DataFrame, model: str = "literal") -> DataFrame:
    """Adds log magnitude, its error and the phase's."""
    z = [F.col(c) for c in ("i", "q", "ei", "eq")]
    return sweep.withColumns({"logmag": iq.log_magnitude(*z[:2]), "elogmag": iq.log_magnitude_error(*z, model), "ephi": iq.phase_error(*z)})


def axis_limits(spectra: DataFrame, value: str = "logmag") -> DataFrame:
    return spectra.groupBy("sweep_id").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def wideband_plan(bands: DataFrame, clip: tuple[float, float] | None = None, seed: int = 0) -> DataFrame:
    """(sweep_id, tone, centre_hz, points, span_hz) of sweeps of many tones side by side: bands(sweep_id, centre_hz,
    bandwidth_hz, n_tones, step_hz). Tones are moved by up to half a step, by a number hashed from seed, sweep and tone, so
    that a retried task gives the same; clip holds the centres within two frequencies."""
    spacing = F.col("bandwidth_hz") / F.col("n_tones")
    points = F.floor(F.col("bandwidth_hz") / F.col("step_hz") / F.col("n_tones"))
    out = bands.withColumns({"points": points, "spacing": spacing}).withColumn("span_hz", F.col("spacing") * (F.col("points") - 1) / F.col("points"))
    out = out.withColumn("tone", F.explode(F.expr("sequence(0, CAST(n_tones AS INT) - 1)")))
    moved = F.col("centre_hz") - F.col("bandwidth_hz") / 2 + F.col("tone") * F.col("spacing") + (hashed_uniform(seed, F.col("sweep_id"), F.col("tone")) - 0.5) * (F.col("span_hz") / F.col("points"))
    centre = moved + F.floor(F.col("points") / 2) * F.col("spacing") / F.col("points")
    if clip:
        centre = F.least(F.greatest(centre, F.lit(clip[0])), F.lit(clip[1]))
    return out.select("sweep_id", "tone", centre.alias("centre_hz"), "points", "span_hz")


#: Samples and tones of one product.
BLOCK_SAMPLES, BLOCK_TONES = 4096, 256


def waveform(tones: DataFrame, n_samples: int, fs_hz: float) -> DataFrame:
    """(tone_set, sample, i, q) of the sum of amplitude exp(j (2 pi freq_hz k / fs + phase)) over the tones of each set of
    tones(tone_set, tone, freq_hz, amplitude, phase).

    Blocks of tones meet blocks of samples; each pair is one NumPy product, and the sums of a set's tone blocks are added
    up by sample. So neither a set's tones nor its samples are ever in one task, however many there are.
    """
    import numpy as np

    # Tones of one frequency and phase add up; the others are dealt to blocks by hash, so no task ranks a set.
    tones = tones.groupBy("tone_set", "freq_hz", F.col("phase").cast("double").alias("phase")).agg(F.sum(F.col("amplitude").cast("double")).alias("amplitude"))
    most = tones.groupBy("tone_set").count().agg(F.max("count")).first()[0] or 0
    block = F.pmod(F.xxhash64("freq_hz", "phase"), F.lit(-(-most // BLOCK_TONES) or 1))
    blocks = tones.groupBy("tone_set", block.alias("block")).agg(F.collect_list(F.struct("freq_hz", "amplitude", "phase")).alias("z"))
    work = blocks.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_samples - 1)), F.lit(BLOCK_SAMPLES)))).repartition("tone_set", "block", "at")

    def synthesise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, z, at in zip(*(batch.column(c).to_pylist() for c in ("tone_set", "z", "at")), strict=True):
                f, a, p = (np.array([x[c] for x in z], float) for c in ("freq_hz", "amplitude", "phase"))
                k = np.arange(at, min(at + BLOCK_SAMPLES, n_samples))
                s = np.exp(2j * np.pi * ((k[:, None] * (f / fs_hz)[None, :]) % 1.0)) @ (a * np.exp(1j * p))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(s.real.copy()), pa.array(s.imag.copy())], ["tone_set", "sample", "i", "q"])

    work = work.withColumn("tone_set", F.col("tone_set").cast("string"))
    return work.mapInArrow(synthesise, "tone_set string, sample long, i double, q double").groupBy("tone_set", "sample").agg(F.sum("i").alias("i"), F.sum("q").alias("q"))


def crest_factors(samples: DataFrame, *keys: str) -> DataFrame:
    """Peak over root mean square of i and q, and the same in dB."""
    peak = lambda c: F.try_divide(F.max(F.abs(c)), F.sqrt(F.avg(F.col(c) * F.col(c))))
    out = samples.groupBy(*keys).agg(peak("i").alias("crest_i"), peak("q").alias("crest_q"))
    return out.withColumns({"crest_i_db": 20 * F.log10("crest_i"), "crest_q_db": 20 * F.log10("crest_q")})
