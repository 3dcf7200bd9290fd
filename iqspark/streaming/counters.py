"""Counters of live streams: gaps, restarts and trigger times by state, in the order of the recording however files land."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.epochs import COUNTER, MOST_STEP

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Frames of a run at most: what a row of runs() stands for.
RUN = 65_536
RUNS = "stream_id string, chunk string, seq long, counters array<long>, keys array<long>"
FIGURES = "stream_id string, last_counter long, n_frames long, n_gaps long, n_missing long, n_restarts long, n_late long"
TIMES = "stream_id string, chunk string, seq long, packet_counter long, epoch long, counter64 long, t double"


class Run(NamedTuple):
    """Frames seq to last_seq of a chunk, and what there is to know of their counters: the first and last one, steps that
    leave out values and how many, restarts, and wraps and first counter of the last epoch."""

    seq: int
    last_seq: int
    first: int
    last: int
    n: int
    gaps: int
    missing: int
    restarts: int
    wraps: int
    start: int


class Tail(NamedTuple):
    """Where a stream stands after some of its runs: counter, epoch, wraps in it and its first counter; and its figures."""

    last: int | None = None
    epoch: int = 0
    wraps: int = 0
    start: int = 0
    n: int = 0
    gaps: int = 0
    missing: int = 0
    restarts: int = 0


def steps_of(counters: np.ndarray, most_step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(step modulo 2**32 to each counter but the first, epoch, wraps in the epoch, first counter of the epoch)."""
    step = np.diff(counters) % COUNTER
    again = step > most_step
    epoch = np.concatenate([[0], np.cumsum(again)])
    opens = np.concatenate([[0], np.flatnonzero(again) + 1])
    wraps = np.concatenate([[0], np.cumsum(~again & (np.diff(counters) < 0))])
    return step, epoch, wraps - wraps[opens][epoch], counters[opens][epoch]


def run_of(seq: int, last_seq: int, counters: np.ndarray, most_step: int) -> Run:
    step, epoch, wraps, start = steps_of(counters, most_step)
    on = step[(step <= most_step) & (step > 0)]
    return Run(seq, last_seq, int(counters[0]), int(counters[-1]), len(counters), int((on > 1).sum()), int((on - 1).sum()), int(epoch[-1]), int(wraps[-1]), int(start[-1]))


def seam(tail: Tail, run: Run, most_step: int) -> Tail:
    """The tail as the run's first frame sees it: its epoch, wraps and start are those of that frame."""
    if tail.last is None:
        return tail._replace(start=run.first)
    step = (run.first - tail.last) % COUNTER
    if step > most_step:
        return tail._replace(epoch=tail.epoch + 1, wraps=0, start=run.first, restarts=tail.restarts + 1)
    return tail._replace(wraps=tail.wraps + (run.first < tail.last), gaps=tail.gaps + (step > 1), missing=tail.missing + max(step - 1, 0))


def after(at: Tail, run: Run) -> Tail:
    """The tail behind a run, from the one that seam gave."""
    moved = {"wraps": run.wraps, "start": run.start} if run.restarts else {"wraps": at.wraps + run.wraps}
    return at._replace(last=run.last, epoch=at.epoch + run.restarts, n=at.n + run.n, gaps=at.gaps + run.gaps, missing=at.missing + run.missing, restarts=at.restarts + run.restarts, **moved)


def runs(frames: DataFrame, most: int = RUN) -> DataFrame:
    """frames as RUNS: one row for frames that follow each other in a chunk, where they stand in a partition, before
    anything is shuffled. keys are hashes of whole frames, by which those that land again are known."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.to_pandas()
            fresh = (at["stream_id"] != at["stream_id"].shift()) | (at["chunk"] != at["chunk"].shift()) | (at["seq"] != at["seq"].shift() + 1)
            opens = np.flatnonzero(fresh.to_numpy() | (np.arange(len(at)) % most == 0))
            ends = np.append(opens[1:], len(at))
            lists = [[at[c].to_numpy(np.int64)[a:b] for a, b in zip(opens, ends, strict=True)] for c in ("packet_counter", "key")]
            columns = [*(at[c].to_numpy()[opens] for c in ("stream_id", "chunk", "seq")), *lists]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["stream_id", "chunk", "seq", "counters", "keys"])

    return frames.select("stream_id", "chunk", "seq", "packet_counter", frame_key().alias("key")).mapInArrow(gathered, RUNS)


def frame_key() -> Column:
    """64 bits of all that a frame says; a frame that landed twice, in whatever file, has them twice."""
    return F.xxhash64("packet_counter", "packet_error", "flags", "i", "q")


class Counters(StatefulProcessor):
    """State of a stream: a map from (chunk, seq) to the run there with its frames' keys, and a value that sums up the runs
    of chunks that are older than delay_ms, which no late file may come before any more. A timer folds them, so the map
    stays as large as what lands within the delay."""

    def __init__(self, most_step: int, delay_ms: int, rate: float | None):
        self.most_step, self.delay_ms, self.rate = most_step, delay_ms, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("runs", "chunk string, seq long", ", ".join(f"{x} long" for x in Run._fields) + ", landed long, keys binary")
        self.folded = handle.getValueState("folded", "chunk string, late long, " + ", ".join(f"{x} long" for x in Tail._fields))

    def _state(self) -> tuple[str | None, int, Tail, dict[tuple[str, int], tuple[Run, int]], np.ndarray]:
        base = self.folded.get() if self.folded.exists() else (None, 0, *Tail())
        runs, keys = {}, [np.zeros(0, np.int64)]
        for k, v in self.held.iterator():
            runs[k[0], k[1]] = (Run(*v[: len(Run._fields)]), v[-2])
            keys.append(np.frombuffer(v[-1], np.int64))
        return base[0], base[1], Tail(*base[2:]), runs, np.concatenate(keys)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        chunk, late, tail, held, known = self._state()
        now = int(timerValues.getCurrentProcessingTimeInMs())
        arrived = sorted(((r.chunk, int(r.seq), np.asarray(r.counters, np.int64), np.asarray(r.keys, np.int64)) for batch in rows for r in batch.itertuples(index=False)), key=lambda r: r[:2])
        fresh: dict[tuple[str, int], np.ndarray] = {}
        if arrived:
            every = np.concatenate([r[3] for r in arrived])
            first = np.zeros(len(every), bool)
            first[np.unique(every, return_index=True)[1]] = True
            new = np.split(first & ~np.isin(every, known), np.cumsum([len(r[3]) for r in arrived])[:-1])
            for (name, seq, counters, keys), keep in zip(arrived, new, strict=True):
                if chunk is not None and name <= chunk:
                    late += int(keep.sum())
                    continue
                for part in np.split(at := np.flatnonzero(keep), np.flatnonzero(np.diff(at) > 1) + 1):
                    if len(part):
                        run = run_of(seq + int(part[0]), seq + int(part[-1]), counters[part], self.most_step)
                        held[name, run.seq], fresh[name, run.seq] = (run, now), counters[part]
                        self.held.updateValue((name, run.seq), (*run, now, keys[part].tobytes()))
        self.folded.update((chunk, late, *tail))
        if fresh:
            self.handle.registerTimer(now + self.delay_ms)
        yield self._result(key[0], late, tail, held, fresh)

    def _result(self, stream: str, late: int, tail: Tail, held: dict, fresh: dict) -> pd.DataFrame:
        out = []
        for (name, seq), (run, _) in sorted(held.items()):
            at = seam(tail, run, self.most_step)
            if self.rate and (name, seq) in fresh:
                counters = fresh[name, seq]
                _, epoch, wraps, start = steps_of(counters, self.most_step)
                head = epoch == 0
                counter64 = counters + COUNTER * (wraps + np.where(head, at.wraps, 0))
                out.append(pd.DataFrame({"stream_id": stream, "chunk": name, "seq": seq + np.arange(len(counters)), "packet_counter": counters, "epoch": epoch + at.epoch, "counter64": counter64, "t": (counter64 - np.where(head, at.start, start)) / self.rate}))
            tail = after(at, run)
        if self.rate:
            return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in TIMES.split(", ")})
        return pd.DataFrame({"stream_id": [stream], "last_counter": [tail.last], "n_frames": [tail.n], "n_gaps": [tail.gaps], "n_missing": [tail.missing], "n_restarts": [tail.restarts], "n_late": [late]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        chunk, late, tail, held, _ = self._state()
        now = int(timerValues.getCurrentProcessingTimeInMs())
        young = min((name for (name, _), (_, landed) in held.items() if landed > now - self.delay_ms), default=None)
        for (name, seq), (run, _) in sorted(held.items()):
            if young is not None and name >= young:
                break
            chunk, tail = name, after(seam(tail, run, self.most_step), run)
            self.held.removeKey((name, seq))
        self.folded.update((chunk, late, *tail))
        yield from ()

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """Typed state needs the RocksDB store; a session that names another one for its own queries has to choose."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(name, "HDFSBackedStateStoreProvider"):
        spark.conf.set(name, _ROCKS)


def _delay_ms(delay: str) -> int:
    number, unit = delay.split()
    return int(float(number) * 1000 * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")])


def live_gaps(frames: DataFrame, most_step: int = MOST_STEP, delay: str = "10 minutes") -> DataFrame:
    """FIGURES of each stream after every batch (update mode) of frames and their chunk (live_frames).

    The same as gap_figures gives over all frames so far, whatever the order in which files land, and through restarts of
    the query: state are the runs of counters in the order (chunk, seq). Frames that land again, in the same file or in
    another one, count once (which of them keeps its place is up to landing); so a copy is told from a board that counts
    from the same number again. A file that sorts before one that was folded (after delay) can't be placed: its frames are
    counted in n_late only. Counters meet the state as runs, a row for up to RUN frames.
    """
    with_state_store(frames.sparkSession)
    return runs(frames).groupBy("stream_id").transformWithStateInPandas(Counters(most_step, _delay_ms(delay), None), FIGURES, "Update", "ProcessingTime")


def live_trigger_times(frames: DataFrame, rate: float, most_step: int = MOST_STEP, delay: str = "10 minutes") -> DataFrame:
    """TIMES of triggered frames (append mode): epoch, 64-bit counter and seconds since the epoch's first frame, each once.

    As in trigger_times over all frames that have landed by then: a file that lands late gets the times of its place, but
    what was given out before stays, though a late file may turn out to begin an epoch.
    """
    with_state_store(frames.sparkSession)
    return runs(frames).groupBy("stream_id").transformWithStateInPandas(Counters(most_step, _delay_ms(delay), rate), TIMES, "Append", "ProcessingTime")


def in_order(frames: DataFrame) -> DataFrame:
    """Frames with order, the place of (chunk, seq) in the stream: 2**40 places for each chunk, by one row a chunk. Of
    frames that are there twice, the first stays."""
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("chunk"))
    chunks = frames.select("stream_id", "chunk").distinct().withColumn("number", number)
    placed = frames.withColumn("key", frame_key()).join(chunks, ["stream_id", "chunk"]).withColumn("order", F.col("number") * 2**40 + F.col("seq"))
    columns = ["stream_id", "chunk", "seq", "packet_counter", "order"]
    return placed.groupBy("stream_id", "key").agg(F.min_by(F.struct(*columns), "order").alias("x")).select("x.*")


def gap_figures(frames: DataFrame, most_step: int = MOST_STEP) -> DataFrame:
    """The figures of live_gaps over a whole table, in ranges (n_late is 0)."""
    from ..operators.frames import counter_steps

    ordered = in_order(frames).select("stream_id", F.col("order").alias("seq"), "packet_counter")
    steps = counter_steps(ordered).withColumn("again", F.coalesce(F.col("step_mod") > most_step, F.lit(False)))
    on = ~F.col("again") & (F.col("step_mod") > 0)
    return steps.groupBy("stream_id").agg(
        F.max_by("packet_counter", "seq").alias("last_counter"), F.count("*").alias("n_frames"), F.count_if(on & (F.col("step_mod") > 1)).alias("n_gaps"),
        F.coalesce(F.sum(F.when(on, F.col("step_mod") - 1)), F.lit(0)).alias("n_missing"), F.count_if("again").alias("n_restarts"), F.lit(0).cast("long").alias("n_late"),
    )


def trigger_times(frames: DataFrame, rate: float, most_step: int = MOST_STEP) -> DataFrame:
    """TIMES over a whole table."""
    from ..operators.epochs import with_epochs

    ordered = in_order(frames).select("stream_id", "chunk", F.col("seq").alias("place"), F.col("order").alias("seq"), "packet_counter")
    out = with_epochs(ordered, most_step)
    return out.select("stream_id", "chunk", F.col("place").alias("seq"), "packet_counter", "epoch", "counter64", (F.col("rebased") / rate).alias("t"))
