"""Queries over files that Spark writes from the given tables and reads back, and over streams of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, sweeps
from ..sources import records, text
from ..sources.shared import new_path
from ..streaming import counters, live
from . import inputs
from .queries import _EPOCHS, RESP_E, _response, _restarted, _with, r, register, rnd


@register(_with("fr", "SELECT seq, packet_counter, packet_error, (label = 2)::INT AS flag2, i, q FROM fr"))
def s1_recording_file(spark, d):
    """Packed records as Parquet of payloads, by stream and ranges of seq."""
    path = new_path(spark, "recording")
    records.write_recording(inputs.frames_e(spark, d), path)
    return records.read_packed(spark, path, 32).select("seq", "packet_counter", "packet_error", F.col("flags")[2].alias("flag2"), "i", "q")


_TWO = "SELECT 'wide' AS stream_id, seq // 2 AS seq, packet_counter, packet_error, i, q FROM fr WHERE seq % 2 = 0 UNION ALL SELECT 'narrow', seq // 2, packet_counter, packet_error, i[1:5], q[1:5] FROM fr WHERE seq % 2 = 1"


def _two_streams(spark, d):
    """Frames E as two streams: even ones with all 32 tones, odd ones with the first 5."""
    wide = F.col("seq") % 2 == 0
    part = lambda c: F.when(wide, F.col(c)).otherwise(F.slice(c, 1, 5)).alias(c)
    return inputs.frames_e(spark, d).select(F.when(wide, "wide").otherwise("narrow").alias("stream_id"), F.floor(F.col("seq") / 2).alias("seq"), "packet_counter", "packet_error", "flags", part("i"), part("q"))


@register(_with("fr", _TWO))
def s1_s2_recordings_by_sidecar(spark, d):
    """Flat files of two streams of different widths, each read by the sidecar beside it."""
    path = new_path(spark, "recordings")
    records.write_recording_files(_two_streams(spark, d), path, {"sample_rate": 500.0, "date": "x"})
    return records.read_recording(spark, path, records=64).select("stream_id", "seq", "packet_counter", "packet_error", "i", "q")


@register(_with("fr", f"SELECT *, len(i)::INT AS n_tones, 250.0::DOUBLE AS sample_rate FROM ({_TWO})"))
def s5_s6_headed_csvs(spark, d):
    """A sample file and a stream file of different widths in one folder: each header shapes its file's frames."""
    path, both = new_path(spark, "headed"), _two_streams(spark, d)
    for name, order in (("wide", "samples"), ("narrow", "stream")):
        text.write_frames_csv(both.where(F.col("stream_id") == name), path, None, {"date": "x", "sample_rate": 250.0}, order)
    return text.read_frames_csv(spark, path).select("stream_id", "seq", "packet_counter", "packet_error", "i", "q", F.size("tones").alias("n_tones"), "sample_rate")


@register("SELECT 'E' AS stream_id, 32 AS num_tones, 500.0::DOUBLE AS sample_rate, 72 AS index_cnt, 73 AS index_err, count(*)::VARCHAR AS frames FROM embeddings")
def s2_sidecar(spark, d):
    path = new_path(spark, "sidecar")
    n = inputs.frames_e(spark, d).agg(F.count("*").cast("string").alias("frames"))
    json = F.to_json(F.struct(F.lit("x").alias("date"), F.lit(32).alias("num_tones"), F.lit(500.0).alias("sample_rate"), F.lit("<i4").alias("format"), F.lit(73).alias("index_err"), F.lit(72).alias("index_cnt"), F.struct("frames").alias("system_information")))
    n.select(json.alias("value")).write.text(path)
    return records.sidecar(spark, path).select(F.lit("E").alias("stream_id"), "num_tones", "sample_rate", "index_cnt", "index_err", F.col("system_information")["frames"].alias("frames"))


def _csv(spark, d, order, read):
    path = new_path(spark, order)
    text.write_frames_csv(inputs.frames_e(spark, d), path, 32, {"date": "x", "sample_rate": 500.0}, order)
    return read(spark, path, 32, "E")


_STEPS = _with("fr", "SELECT stream_id, seq, seq/500.0 AS t, packet_counter - lag(packet_counter) OVER (ORDER BY seq) AS step, packet_error, (label = 3)::INT AS flag3, i, q FROM fr")


def _stepped(df):
    out = frames.index_time(frames.counter_steps(df, 64), 500.0)
    return out.select("stream_id", "seq", "t", "step", "packet_error", F.col("flags")[3].alias("flag3"), "i", "q")


@register(_STEPS)
def s5_samples_csv(spark, d):
    """A sample file read back, with the order of its lines: time axis and counter steps need it."""
    return _stepped(_csv(spark, d, "samples", text.read_samples_csv))


@register(_STEPS)
def s6_stream_csv(spark, d):
    return _stepped(_csv(spark, d, "stream", text.read_stream_csv))


_SWEEP = _with(f"e | {RESP_E}", f"SELECT sweep_id, tone, point, {r('f', 3)} AS f, {r('i')} AS i, {r('q')} AS q, {r('ei')} AS ei, {r('eq')} AS eq FROM resp")


def _swept(df):
    return df.select("sweep_id", "tone", "point", rnd("f", 3).alias("f"), *[rnd(c).alias(c) for c in ("i", "q", "ei", "eq")])


@register(_SWEEP)
def s7_sweep_csv(spark, d):
    path = new_path(spark, "sweep")
    text.write_sweep_csv(_response(inputs.sweep_e(spark, d)), path, 32, {"num_tones": 32})
    return _swept(text.read_sweep_csv(spark, path, 32, "E"))


@register(_with("fr", "SELECT seq, packet_counter, packet_error, (label = 4)::INT AS flag4, t::INT AS tone, i[t+1] AS i, q[t+1] AS q FROM fr, range(32) r(t)"))
def s8_json_document(spark, d):
    path = new_path(spark, "document")
    text.write_json_document(inputs.frames_e(spark, d), path, 32, {"date": "x", "sample_rate": 500.0})
    back = text.read_json_document(spark, path)
    # A document numbers its samples from 0; the recording's first seq is that of the table.
    first = inputs.frames_e(spark, d).agg(F.min("seq").alias("s0"))
    return back.join(F.broadcast(first)).select((F.col("seq") + F.col("s0")).alias("seq"), "packet_counter", "packet_error", F.col("flags")[4].alias("flag4"), "tone", "i", "q")


@register(_SWEEP)
def s8_sweep_document(spark, d):
    path = new_path(spark, "sweeps")
    text.write_sweep_document(_response(inputs.sweep_e(spark, d)), path, {"date": "x", "samples_per_point": 1})
    return _swept(text.read_sweep_document(spark, path))


_WHICH = "CASE WHEN tone % 3 = 0 THEN 'third' ELSE 'rest' END"
_VALUES = f"point, {r('f', 3)} AS f, {r('i')} AS i, {r('q')} AS q, {r('ei')} AS ei, {r('eq')} AS eq FROM resp"
_SPLIT = _with(f"e | {RESP_E}", f"SELECT {_WHICH} AS sweep_id, tone, {_VALUES}")


def _two_sweeps(spark, d):
    return _response(inputs.sweep_e(spark, d)).withColumn("sweep_id", F.when(F.col("tone") % 3 == 0, "third").otherwise("rest"))


@register(_SPLIT)
def s7_two_sweep_csvs(spark, d):
    """Two sweeps of different tones give two files, read by their own headers."""
    path = new_path(spark, "two-sweeps")
    text.write_sweep_csv(_two_sweeps(spark, d), path, None, {"num_points": 10})
    return _swept(text.read_sweep_csv(spark, path))


@register(_with(f"e | {RESP_E}", f"SELECT {_WHICH} AS sweep_id, (dense_rank() OVER (PARTITION BY {_WHICH} ORDER BY tone) - 1)::INT AS place, {_VALUES}"))
def s8_two_sweep_documents(spark, d):
    """A document numbers its sweep's tones from 0."""
    path = new_path(spark, "two-documents")
    text.write_sweep_document(_two_sweeps(spark, d), path, {"date": "x"})
    return _swept(text.read_sweep_document(spark, path)).withColumnRenamed("tone", "place")


@register(_with("e", f"SELECT sample, point, tone, {r('i')} AS i, {r('q')} AS q FROM e"))
def s10_sweep_cube(spark, d):
    """Each spectrum as a cube of one sample, one point and 32 tones, in base64."""
    one = inputs.sweep_e(spark, d).withColumns({"sweep_id": F.concat_ws(":", "sample", "point"), "sample": F.lit(0), "point": F.lit(0)})
    back = text.decode_cubes(text.encode_cubes(one.select("sweep_id", "sample", "point", "tone", "i", "q")))
    name = F.split("sweep_id", ":")
    return back.select(name[0].cast("int").alias("sample"), name[1].cast("int").alias("point"), "tone", rnd("i").alias("i"), rnd("q").alias("q"))


@register(_SPLIT)
def s9_payload_files(spark, d):
    """Two payloads in base64, encoded in pieces."""
    path = new_path(spark, "payloads")
    text.write_sweep_payloads(_two_sweeps(spark, d), path, {"samples_per_point": 1})
    back = _swept(text.read_sweep_payloads(spark, path))
    # A payload numbers its tones from 0: those of the first sweep are 0, 3, ..., of the other 1, 2, 4, ...
    tone = F.when(F.col("sweep_id") == "third", F.col("tone") * 3).otherwise(F.expr("tone div 2 * 3 + tone % 2 + 1"))
    return back.withColumn("tone", tone.cast("int"))


@register("SELECT 'L' AS sweep_id, count(DISTINCT (l_suppkey, l_linenumber)) AS n_landed, count(DISTINCT (l_suppkey, l_linenumber)) / (7 * (SELECT max(l_suppkey) + 1.0 FROM lineitem)) AS share, count(DISTINCT (l_suppkey, l_linenumber)) = 7 * (SELECT max(l_suppkey) + 1 FROM lineitem) AS complete FROM lineitem WHERE l_orderkey % 211 < 2")
def a10_live_progress(spark, d):
    """Samples land in files; the bitmaps of what has landed are the state of a stream."""
    line = inputs.table(spark, d, "lineitem")
    tones, landing = line.agg(F.max("l_suppkey")).first()[0] + 1, new_path(spark, "samples")
    samples = line.where("l_orderkey % 211 < 2").select(F.lit("L").alias("sweep_id"), F.col("l_suppkey").cast("int").alias("tone"), (F.col("l_linenumber") - 1).cast("int").alias("point"))
    for _ in range(2):  # what lands twice counts once
        samples.write.mode("append").parquet(landing)
    live_samples = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    bitmaps = _drained(spark, sweeps.landed_bitmaps(live_samples, 7, tones), "progress", mode="complete")
    return sweeps.landed(bitmaps, 7, tones)


_CUBES = "cu AS (SELECT CASE WHEN vec_id // 100 < n // 100 THEN 'c' || vec_id // 100 ELSE 'r' || vec_id END AS sweep_id, CASE WHEN vec_id // 100 < n // 100 THEN vec_id % 100 // 10 ELSE 0 END AS sample, CASE WHEN vec_id // 100 < n // 100 THEN vec_id % 10 ELSE 0 END AS point, label, embedding FROM embeddings, (SELECT max(vec_id) + 1 AS n FROM embeddings))"


@register(f"WITH {_CUBES} SELECT sweep_id, t::INT AS tone, point::INT AS point, {r('avg(embedding[2*t+1]::DOUBLE)')} AS i, {r('avg(embedding[2*t+2]::DOUBLE)')} AS q, count(*) AS n, max(label)::INT AS last_count FROM cu, range(32) r(t) WHERE label <> 9 GROUP BY sweep_id, t, point")
def s10_raw_cubes(spark, d):
    """Raw cubes of 10 samples, 10 points and 32 tones (vectors beyond the last hundred make cubes of one), with counts and
    errors of their accumulations: their response without the samples that have an error."""
    e = inputs.table(spark, d, "embeddings").select("vec_id", "label").join(F.broadcast(inputs.table(spark, d, "embeddings").agg((F.max("vec_id") + 1).alias("n"))))
    full = F.expr("vec_id div 100 < n div 100")
    place = e.select(F.col("vec_id").alias("v"), F.when(full, F.expr("concat('c', vec_id div 100)")).otherwise(F.expr("concat('r', vec_id)")).alias("sweep_id"), F.when(full, F.expr("vec_id % 100 div 10")).otherwise(0).cast("int").alias("sample"), F.when(full, F.expr("vec_id % 10")).otherwise(0).cast("int").alias("point"), "label")
    raw = inputs.sweep_e(spark, d).select(F.col("sample").alias("v"), "tone", "i", "q").join(place, "v").select("sweep_id", "sample", "point", "tone", "i", "q")
    back = text.decode_cubes(text.encode_cubes(raw))
    counted = sweeps.with_accumulations(back, place.select("sweep_id", "sample", "point", F.col("label").alias("acc_count"), (F.col("label") == 9).cast("int").alias("acc_err")))
    out = sweeps.response(counted, drop_errors=True).join(counted.where("packet_error = 0").groupBy("sweep_id", "tone", "point").agg(F.max("packet_counter").alias("last_count")), ["sweep_id", "tone", "point"])
    return out.select("sweep_id", "tone", "point", rnd("i").alias("i"), rnd("q").alias("q"), "n", "last_count")


@register("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS cal_order, 8.5e8 + s_suppkey*1.5e6 AS freq_hz, s_acctbal::DOUBLE/1e4 AS value_db FROM supplier")
def s12_calibration_text(spark, d):
    """cal_order is the place of a line in its file."""
    path = new_path(spark, "calibration")
    text.write_calibration(inputs.cal_s(spark, d), path)
    return text.read_calibration(spark, path, "S").select("cal_order", "freq_hz", "value_db")


@register(_with("p", "SELECT printf('K%03d', tone) AS name, round(freq_hz, 6) AS freq_hz, 0.0::DOUBLE AS offset_att, 1 AS all_flag, 0 AS none_flag FROM p"))
def s13_tone_list(spark, d):
    path = new_path(spark, "tones")
    text.write_tone_list(inputs.tones_p(spark, d), path)
    return text.read_tone_list(spark, path).select("name", "freq_hz", "offset_att", "all_flag", "none_flag")


@register(_with("fr", "SELECT stream_id, seq, packet_counter, packet_error, i, q FROM fr"))
def s15_parquet_store(spark, d):
    path = new_path(spark, "store")
    records.store(inputs.frames_e(spark, d), path, 100)
    return records.load(spark, path).select("stream_id", "seq", "packet_counter", "packet_error", "i", "q")


def _landed(spark, d) -> str:
    """The recording as chunk files in a landing folder that executors share, by stream."""
    path = new_path(spark, "landing")
    records.write_flat(inputs.frames_e(spark, d), path, frames_per_chunk=400)
    return path


def _drained(spark, df, name, mode=None, path=None, state=None):
    """What a stream gives for all that has landed by now; with path and state, after what it gave before."""
    path, state = path or new_path(spark, name), state or new_path(spark, f"{name}-state")
    writer = df.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode:
        query = writer.outputMode(mode).foreachBatch(lambda b, k: b.write.mode("overwrite" if mode == "complete" else "append").parquet(path)).start()
    else:
        query = writer.format("parquet").option("path", path).start()
    query.awaitTermination()
    return spark.read.parquet(path)


@register(_with("fr", "SELECT stream_id, packet_counter, packet_error, i, q FROM fr"))
def ts1_ts6_live_frames(spark, d):
    out = _drained(spark, live.live_frames(spark, _landed(spark, d), 32), "live")
    return out.select("stream_id", "packet_counter", "packet_error", "i", "q")


@register(_with("fr", "SELECT stream_id, lpad((seq // 400)::VARCHAR, 12, '0') AS chunk, seq % 400 AS place, packet_counter, i[32] AS last_i FROM fr"))
def ts1_chunks_in_ranges(spark, d):
    """Chunks are read in ranges of 33 records, and batches of at most 250; a frame's place is that in its chunk."""
    frames_ = live.live_frames(spark, _landed(spark, d), 32, records=33, per_trigger=250)
    out = _drained(spark, frames_, "ranges")
    return out.select("stream_id", F.regexp_extract("chunk", "chunk-([0-9]+)", 1).alias("chunk"), F.col("seq").alias("place"), "packet_counter", F.col("i")[31].alias("last_i"))


def _with_ends(spark, d, ends) -> str:
    """A landing folder whose chunks end in some more bytes each."""
    from ..sources.sinks import write_files

    path = new_path(spark, "short-ends")
    packed = records.encode(inputs.frames_e(spark, d)).select(F.format_string("%s/c-%03d.bin", "stream_id", F.floor(F.col("seq") / 100)).alias("name"), F.col("seq").alias("place"), F.col("payload").alias("value"))
    more = packed.groupBy("name").agg(F.max("place").alias("place")).select("name", F.col("place") + 1, ends)
    write_files(packed.unionByName(more.toDF("name", "place", "value")), path)
    return path


@register(_with("fr", "SELECT count(*) AS n_frames, count(DISTINCT seq // 100) AS n_chunks FROM fr"))
def ts2_keep_alives(spark, d):
    """Empty chunks among the others give nothing."""
    from ..sources.sinks import write_files

    path = _with_ends(spark, d, F.lit("").cast("binary"))
    alive = inputs.frames_e(spark, d).select(F.format_string("%s/c-%03d-alive.bin", "stream_id", F.floor(F.col("seq") / 100)).alias("name")).distinct()
    write_files(alive.select("name", F.lit(0).cast("long").alias("place"), F.lit("").alias("value")), path)
    return _drained(spark, live.live_frames(spark, path, 32), "alive").agg(F.count("*").alias("n_frames"), F.count_distinct("chunk").alias("n_chunks"))


@register(_with("fr", "SELECT stream_id, packet_counter, packet_error, i, q FROM fr"))
def ts3_short_last_records(spark, d):
    """Each chunk ends in 13 bytes of a record that is not whole."""
    out = _drained(spark, live.live_frames(spark, _with_ends(spark, d, F.lit("x" * 13).cast("binary")), 32, records=50), "short")
    return out.select("stream_id", "packet_counter", "packet_error", "i", "q")


@register(_with("fr", "SELECT stream_id, packet_counter, epoch_us(TIMESTAMP '2024-01-01 00:00:00') + packet_counter*2000 AS us FROM fr"))
def ts3_without_repeats(spark, d):
    """Chunk files that land twice, under two names, count once."""
    path = _landed(spark, d)
    records.write_flat(inputs.frames_e(spark, d), path, prefix="again")
    timed = live.with_event_time(live.live_frames(spark, path, 32), "2024-01-01 00:00:00", 500.0)
    out = _drained(spark, live.without_repeats(timed), "distinct")
    return out.select("stream_id", "packet_counter", F.unix_micros("ts").alias("us"))


@register(_with("fr", "SELECT stream_id, max(packet_counter) AS last_counter, count(*) AS n_frames, sum((step > 1)::INT)::BIGINT AS n_gaps, sum(coalesce(step - 1, 0))::BIGINT AS n_missing FROM (SELECT *, packet_counter - lag(packet_counter) OVER (PARTITION BY stream_id ORDER BY seq) AS step FROM fr) GROUP BY stream_id"))
def ts4_live_gaps(spark, d):
    out = _drained(spark, counters.live_gaps(live.live_frames(spark, _landed(spark, d), 32)), "gaps", mode="update")
    return _last_figures(out).drop("n_restarts", "n_late")


def _last_figures(out):
    last = out.groupBy("stream_id").agg(F.max_by(F.struct(*[c for c in out.columns if c != "stream_id"]), "n_frames").alias("x"))
    return last.select("stream_id", "x.*")


def _in_three_triggers(spark, d, derived, name, mode):
    """What a stream gives over three triggers, with a restart of the query before each: chunks of 100 frames with wraps
    and restarts of the counter, of which every third lands with each trigger, so that most land late."""
    frames_ = inputs.frames_e(spark, d).drop("packet_counter").join(_restarted(spark, d).select("seq", "packet_counter"), "seq")
    landing, out, state = (new_path(spark, f"{name}-{x}") for x in ("landing", "out", "state"))
    for k in (1, 2, 0):
        records.write_flat(frames_.where(F.floor(F.col("seq") / 100) % 3 == k).select(*inputs.frames_e(spark, d).columns), landing, frames_per_chunk=100)
        got = _drained(spark, derived(live.live_frames(spark, landing, 32)), name, mode, out, state)
    return got


_STEPPED = f"SELECT *, (c - p + 4294967296) % 4294967296 AS step FROM ({_EPOCHS})"


@register(_with("fr", f"SELECT stream_id, arg_max(c, seq) AS last_counter, count(*) AS n_frames, sum((again = 0 AND step > 1)::INT)::BIGINT AS n_gaps, sum(CASE WHEN again = 0 AND step > 0 THEN step - 1 ELSE 0 END)::BIGINT AS n_missing, sum(again)::BIGINT AS n_restarts, 0::BIGINT AS n_late FROM ({_STEPPED}) GROUP BY stream_id"))
def ts4_live_gaps_over_wraps(spark, d):
    return _last_figures(_in_three_triggers(spark, d, counters.live_gaps, "wraps", "update"))


@register(_with("fr", f"SELECT stream_id, c AS packet_counter, epoch, counter64::BIGINT AS counter64, round((counter64 - first_value(counter64) OVER (PARTITION BY epoch ORDER BY seq)) / 500.0, 6) + 0.0 AS t FROM ({_EPOCHS})"))
def ts6_trigger_times(spark, d):
    """Chunks land in order, half of them before a restart of the query."""
    frames_ = inputs.frames_e(spark, d).drop("packet_counter").join(_restarted(spark, d).select("seq", "packet_counter"), "seq").select(*inputs.frames_e(spark, d).columns)
    half = frames_.agg(F.floor(F.max("seq") / 200) * 100).first()[0]
    landing, out, state = (new_path(spark, f"times-{x}") for x in ("landing", "out", "state"))
    for part in (F.col("seq") < half, F.col("seq") >= half):
        records.write_flat(frames_.where(part), landing, frames_per_chunk=100)
        got = _drained(spark, counters.live_trigger_times(live.live_frames(spark, landing, 32), 500.0), "times", "append", out, state)
    return got.select("stream_id", "packet_counter", "epoch", "counter64", rnd("t").alias("t"))


@register(_with("fr", "SELECT stream_id, count(*) AS n_frames, sum(packet_error)::BIGINT AS n_errors FROM fr GROUP BY stream_id"))
def ts5_live_errors(spark, d):
    return _drained(spark, live.running_errors(live.live_frames(spark, _landed(spark, d), 32)), "errors", mode="complete")
