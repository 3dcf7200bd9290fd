"""Tone sets: order, spacing, phases, bins, attenuations and calibrated powers."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashed import hashed_uniform
from ..functions.frequency import bin_offset, nearest_bin, phase_increment
from ..functions.powers import TxChain, tone_amplitude, tone_power
from ..params import Board
from ..sources.shared import stored

#: Rows of a calibration table that tasks hold as sorted arrays; a larger one is cut by frequency.
TABLE_ROWS = 4096


def extremes(tones: DataFrame) -> DataFrame:
    return tones.groupBy("tone_set").agg(F.min("freq_hz").alias("f_min"), F.max("freq_hz").alias("f_max"), F.count("*").alias("n"))


def frequency_rank(tones: DataFrame) -> DataFrame:
    return tones.withColumn("rank", F.row_number().over(Window.partitionBy("tone_set").orderBy("freq_hz", "tone")))


def spacing(tones: DataFrame, nominal_hz: float) -> DataFrame:
    """Largest step between neighbours and whether all are close to the nominal one (1e-8 + 1e-5 of it)."""
    step = F.lead("freq_hz").over(Window.partitionBy("tone_set").orderBy("freq_hz", "tone")) - F.col("freq_hz")
    close = F.abs(F.col("step") - nominal_hz) <= 1e-8 + 1e-5 * abs(nominal_hz)
    return tones.withColumn("step", step).groupBy("tone_set").agg(F.max("step").alias("max_step"), F.bool_and(close).alias("even"))


def newman_phases(tones: DataFrame) -> DataFrame:
    """pi k^2 / n with k the tone's place between the extremes, 0 to n - 1; null for a set of one frequency."""
    joined = tones.join(extremes(tones), "tone_set")
    k = F.try_divide(F.col("freq_hz") - F.col("f_min"), F.col("f_max") - F.col("f_min")) * (F.col("n") - 1)
    return joined.withColumn("phase", math.pi * k * k / F.col("n")).drop("f_min", "f_max", "n")


def random_phases(tones: DataFrame, seed: int = 0) -> DataFrame:
    """Uniform in [0, 2 pi), from a hash of seed, set and tone, so that a retried task gives the same."""
    return tones.withColumn("phase", hashed_uniform(seed, F.col("tone_set"), F.col("tone")) * (2 * math.pi))


def active_channels(channels: DataFrame) -> DataFrame:
    """Mapped channels (not -1) in tone order, with the numbers of tones mapped for sending and receiving compared."""
    counts = channels.groupBy("board").agg(F.count(F.when(F.col("tx_bin") != -1, 1)).alias("n_tx"), F.count(F.when(F.col("rx_bin") != -1, 1)).alias("n_rx"))
    return channels.where("tx_bin != -1").join(counts, "board").withColumn("same_count", F.col("n_tx") == F.col("n_rx")).orderBy("board", "tone")


def place_in_bins(tones: DataFrame, baseband: str = "bb_hz", rbw_hz: float = 500e3, board: Board = Board()) -> DataFrame:
    """Adds tx and rx bin, offset from the bin's centre, phase increment and its unit phasor."""
    out = tones
    for side, n in (("tx", board.n_tx_bins), ("rx", board.n_rx_bins)):
        off = bin_offset(F.col(baseband), n, board)
        inc = phase_increment(off, rbw_hz)
        out = out.withColumns({f"{side}_bin": nearest_bin(F.col(baseband), n, board), f"{side}_offset_hz": off, f"{side}_phase_inc": inc, f"{side}_step_re": F.cos(inc), f"{side}_step_im": F.sin(inc)})
    return out


def bin_collisions(placed: DataFrame, *keys: str) -> DataFrame:
    """Bins that several tones of one set (and point) fall into; the last tone is the one that is heard."""
    return placed.groupBy(*keys, "tx_bin").agg(F.count("*").alias("n_tones"), F.max("tone").alias("winner")).where("n_tones > 1")


def unchanged_maps(placed: DataFrame, bin_column: str = "tx_bin") -> DataFrame:
    """Per sweep and point: whether every tone is in the bin of the point before; the first point never is."""
    prev = F.lag(bin_column).over(Window.partitionBy("sweep_id", "tone").orderBy("point"))
    return placed.withColumn("same", F.coalesce(F.col(bin_column) == prev, F.lit(False))).groupBy("sweep_id", "point").agg(F.bool_and("same").alias("skip"))


def attenuations(tones: DataFrame) -> DataFrame:
    """20 log10 |amplitude| less the set's least one."""
    db = 20 * F.log10(F.abs("amplitude"))
    return tones.withColumn("db", db).withColumn("att_db", F.col("db") - F.min("db").over(Window.partitionBy("tone_set"))).drop("db")


def _searched(table: pa.Table, kind: str):
    """The value of a table (cf, o, cv), held as sorted arrays, at the frequency nearest to x: an Arrow function."""
    import pyarrow.compute as pc

    table = table.take(pc.sort_indices(table, [("cf", "ascending")]))
    cf, cv, n = table["cf"].to_numpy(), table["cv"].combine_chunks(), len(table)
    rank = np.empty(n, int)
    rank[pc.sort_indices(table, [("o", "ascending"), ("cv", "ascending")], null_placement="at_start").to_numpy()] = np.arange(n)

    @F.arrow_udf(kind)
    def search(x: pa.Array) -> pa.Array:
        at = x.to_numpy(zero_copy_only=False)
        after = np.searchsorted(cf, at, "right")
        low, high = np.maximum(after - 1, 0), np.minimum(after, n - 1)
        with np.errstate(invalid="ignore"):
            below, above = abs(cf[low] - at), abs(cf[high] - at)
            nearer = (below < above) | (below == above) & (rank[low] < rank[high]) | np.isnan(above)
        return cv.take(pa.array(np.where((after > 0) & nearer, low, high), mask=x.is_null().to_numpy(zero_copy_only=False)))

    return search


#: Frequencies in a range, about: of a table of any size and of the rows that look into it.
RANGE_ROWS = 65_536


def _in_ranges(asked: DataFrame, table: DataFrame) -> DataFrame:
    """(__x, cv): the value of table(cf, o, cv) at the frequency nearest to each of asked(cf), both without repeats.

    The two are put in one order, in ranges: the nearest entry is the last one before a frequency or the first one after
    it, in its range or, by one row for each range, in those beside it. No row ever meets more than these two entries."""
    both = table.select("cf", F.struct("cf", "o", "cv").alias("e"), F.lit(False).alias("asked")).unionByName(asked.select("cf", F.lit(True).alias("asked")), allowMissingColumns=True)
    parts = max(1, -(-both.count() // RANGE_ROWS))
    both = stored(both.repartitionByRange(parts, "cf", "asked").withColumn("part", F.spark_partition_id()), "frequencies")
    up, down = Window.partitionBy("part").orderBy("cf", "asked"), Window.partitionBy("part").orderBy(F.desc("cf"), F.desc("asked"))
    ends = both.groupBy("part").agg(F.min("e").alias("a"), F.max("e").alias("z"))
    one = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    ends = ends.select("part", F.last("z", True).over(one.orderBy("part")).alias("p"), F.last("a", True).over(one.orderBy(F.desc("part"))).alias("q"))
    beside = both.withColumns({"b": F.last("e", True).over(up), "c": F.last("e", True).over(down)}).where("asked").join(F.broadcast(ends), "part")
    away = lambda v: F.when(v.isNotNull(), F.struct(F.abs(v["cf"] - F.col("cf")).alias("d"), v["o"].alias("o"), v["cv"].alias("cv")))
    nearest = F.least(away(F.coalesce("b", "p")), away(F.coalesce("c", "q")))["cv"]
    return beside.select(F.col("cf").alias("__x"), nearest.alias("cv"))


def nearest_value(tones: DataFrame, cal: DataFrame, at: str = "freq_hz", name: str = "value_db") -> DataFrame:
    """Adds the value of cal(cal_order, freq_hz, value_db) at the frequency nearest to each row's; the first row of the
    table wins ties. Null without a table, or for a null frequency.

    A table of up to TABLE_ROWS rows is held by tasks as sorted arrays, which rows are searched in. A larger one meets the
    rows' distinct frequencies in ranges of both, and rows get the value by a join on their frequency. Either way no row
    carries a table or a part of it, and neither many rows at one frequency nor a dense table make a large task.
    """
    rows = cal.select(F.col("cal_order").alias("o"), F.col("freq_hz").cast("double").alias("cf"), F.col("value_db").alias("cv")).where("cf IS NOT NULL")
    # Equal frequencies keep the first row; then the nearest is the last one before or the first one after.
    distinct = rows.groupBy("cf").agg(F.min(F.struct("o", "cv")).alias("r")).select("cf", F.col("r.o").alias("o"), F.col("r.cv").alias("cv"))
    x, kind = F.col(at).cast("double"), distinct.schema["cv"].dataType
    few = distinct.limit(TABLE_ROWS + 1).toArrow()
    if not len(few):
        return tones.withColumn(name, F.lit(None).cast(kind))
    if len(few) <= TABLE_ROWS:
        return tones.withColumn(name, _searched(few, kind)(x))
    found = _in_ranges(tones.select(x.alias("cf")).where("cf IS NOT NULL").distinct(), distinct)
    met = tones.withColumn("__at", x).drop(name)
    return met.join(found, F.col("__at") == F.col("__x"), "left").withColumnRenamed("cv", name).drop("__at", "__x")


def calibration_value(tones: DataFrame, spec: Any, tables: dict[str, DataFrame] | None = None, at: str = "freq_hz", name: str = "value_db", connected: bool = True) -> DataFrame:
    """Adds one stage's value: null or disconnected: 0; a number: itself; pairs or a table's name: nearest_value."""
    if spec is None or not connected:
        return tones.withColumn(name, F.lit(0.0))
    if isinstance(spec, (int, float)):
        return tones.withColumn(name, F.lit(float(spec)))
    if isinstance(spec, str) and tables and spec in tables:
        return nearest_value(tones, tables[spec], at, name)
    if isinstance(spec, str):
        return tones.withColumn(name, F.lit(float(spec)))
    pairs = [(k, float(f), float(v)) for k, (f, v) in enumerate(spec)]
    return nearest_value(tones, tones.sparkSession.createDataFrame(pairs, "cal_order long, freq_hz double, value_db double"), at, name)


#: Stage, and the frequency at which its table is read.
STAGES = {"dac_dbfs_to_dbm": "analog_hz", "combiner_loss_db": "analog_hz", "attenuator_db": "analog_hz", "if_s21_db": "analog_hz", "mixer_loss_db": "analog_hz", "rf_s21_db": "rf_hz", "cryostat_s21_db": "rf_hz"}


def with_stages(tones: DataFrame, specs: dict[str, Any], tables: dict[str, DataFrame] | None = None, frontend: bool = True, cryostat: bool = True) -> DataFrame:
    """Adds the value of every stage of the sending chain to tones(analog_hz, rf_hz)."""
    out = tones
    for stage, axis in STAGES.items():
        wired = cryostat if stage == "cryostat_s21_db" else frontend or stage == "dac_dbfs_to_dbm"
        out = calibration_value(out, specs.get(stage), tables, axis, stage, wired)
    return out


def _chain(settings: dict[str, Any]) -> TxChain:
    return TxChain(**settings, **{s: F.col(s) for s in STAGES})


def tone_powers(staged: DataFrame, settings: dict[str, Any], amplitude: str = "amplitude") -> DataFrame:
    return staged.withColumn("power_dbm", tone_power(F.col(amplitude), _chain(settings)))


def tone_amplitudes(staged: DataFrame, settings: dict[str, Any], power: str = "power_dbm") -> DataFrame:
    return staged.withColumn("amplitude", tone_amplitude(F.col(power), _chain(settings)))


def equal_lengths(*columns: Column) -> Column:
    """True; the job fails if arrays that belong together differ in length."""
    same = F.lit(True)
    for c in columns[1:]:
        same = same & (F.size(c) == F.size(columns[0]))
    return F.when(same, F.lit(True)).otherwise(F.raise_error("lengths differ").cast("boolean"))
