import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from iqspark.operators import frames as ops
from iqspark.sources import records, text
from iqspark.streaming import counters, live


def make(spark, n=50, tones=3, stream="s", first=2**32 - 20):
    rows = [(stream, k, (first + k) % 2**32, k % 7 == 0, [k % 2] * 8, [k * t - 5 for t in range(tones)], [-k * t for t in range(tones)]) for k in range(n)]
    return spark.createDataFrame([(a, b, c, int(d), e, f, g) for a, b, c, d, e, f, g in rows], "stream_id string, seq long, packet_counter long, packet_error int, flags array<int>, i array<int>, q array<int>")


COLS = ["seq", "packet_counter", "packet_error", "flags", "i", "q"]


def rows(df, cols=COLS):
    return sorted(map(tuple, df.select(*cols).collect()))


def packed(df):
    return b"".join(bytes(r.payload) for r in records.encode(df).orderBy("seq").collect())


def test_recording_file_with_short_end(spark, folder):
    df = make(spark)
    path = f"{folder}/s.bin"
    with open(path, "wb") as f:
        f.write(packed(df) + b"\1\2\3")
    got = records.read_recording(spark, path, 3, records=7)
    assert rows(got) == rows(df) and got.first().stream_id == "s"
    assert [len(r.i) for r in records.read_recording(spark, path, 3, keep=2).limit(2).collect()] == [2, 2]
    open(f"{folder}/empty.bin", "wb").close()
    assert records.read_recording(spark, f"{folder}/empty.bin", 3).count() == 0


def test_packed_and_stored_forms(spark, folder):
    df = make(spark)
    records.write_recording(df, f"{folder}/p")
    assert rows(records.read_packed(spark, f"{folder}/p", 3)) == rows(df)
    records.write_flat(df, f"{folder}/flat")
    whole = b"".join(open(f"{folder}/flat/s/{x}", "rb").read() for x in sorted(os.listdir(f"{folder}/flat/s")))
    assert whole == packed(df)
    records.store(df, f"{folder}/q")
    assert rows(records.load(spark, f"{folder}/q")) == rows(df)


def test_sidecar(spark, folder):
    with open(f"{folder}/s.json", "w") as f:
        f.write(records.sidecar_json(3, 500.0, "2024-01-01 00:00:00 UTC+0000", {"acc_len": 1000}))
    r = records.sidecar(spark, f"{folder}/s.json").first()
    assert (r.num_tones, r.index_cnt, r.index_err, r.stream_id, r.system_information["acc_len"]) == (3, 14, 15, "s", "1000")


def test_frame_csvs(spark, folder):
    df = make(spark)
    for order, read in (("samples", text.read_samples_csv), ("stream", text.read_stream_csv)):
        text.write_frames_csv(df, f"{folder}/{order}", 3, {"date": "x", "sample_rate": 500.0}, order)
        assert rows(read(spark, f"{folder}/{order}", 3), COLS[1:]) == rows(df, COLS[1:])
        assert {r.key: r.number for r in text.header(spark, f"{folder}/{order}").collect()} == {"date": None, "sample_rate": 500.0}


def test_json_document(spark, folder):
    df = make(spark)
    text.write_json_document(df, f"{folder}/j", 3, {"date": "x", "sample_rate": 500.0})
    got = text.read_json_document(spark, f"{folder}/j")
    assert rows(got, ["seq", "tone", "i", "q"]) == rows(ops.to_samples(df), ["seq", "tone", "i", "q"])


def long_sweep(spark):
    return spark.createDataFrame([("w", t, p, 1e9 + t + p, p + 0.5, t * 1.5, 0.1, 0.2) for t in range(3) for p in range(5)], "sweep_id string, tone int, point int, f double, i double, q double, ei double, eq double")


def test_sweep_forms(spark, folder):
    s, cols = long_sweep(spark), ["tone", "point", "f", "i", "q", "ei", "eq"]
    text.write_sweep_csv(s, f"{folder}/c", 3, {"num_tones": 3})
    assert rows(text.read_sweep_csv(spark, f"{folder}/c", 3, "w"), cols) == rows(s, cols)
    coded = text.encode_sweeps(s)
    assert rows(text.decode_sweeps(coded), cols) == rows(s, cols)
    assert rows(text.decode_sweeps(coded, "tone_major"), cols) != rows(s, cols)
    text.write_sweep_text(s, f"{folder}/t", {"num_tones": 3})
    lines = [r.value for r in spark.read.text(f"{folder}/t").collect()]
    assert lines[0] == "# num_tones: 3" and len(lines) == 6 and lines[1].startswith("1000000000.000000 0.500000")


def unsteady(spark):
    """A number that has other digits, and another length, each time it is computed: as means do whose parts come in another
    order."""
    import random

    return F.udf(lambda: round(random.random(), random.randint(1, 12)), "double").asNondeterministic()()


def test_sweep_csv_of_values_that_differ_when_computed_again(spark, folder):
    s = long_sweep(spark).withColumns({c: unsteady(spark) for c in ("i", "q")})
    text.write_sweep_csv(s, folder, 3, {"num_tones": 3})
    got = rows(text.read_sweep_csv(spark, folder, 3, "w"), ["tone", "point", "f", "ei", "i"])
    assert [r[:4] for r in got] == rows(long_sweep(spark), ["tone", "point", "f", "ei"]) and all(0 <= r[4] <= 1 for r in got)


def test_two_sweep_csvs_of_values_that_differ_when_computed_again(spark, folder):
    s = long_sweep(spark).withColumns({"sweep_id": F.when(F.col("tone") == 1, "one").otherwise("rest"), "q": unsteady(spark), "eq": unsteady(spark)})
    text.write_sweep_csv(s, folder, None, {"num_points": 5})
    got = rows(text.read_sweep_csv(spark, folder), ["tone", "point", "sweep_id", "f", "q"])
    assert [r[:4] for r in got] == [(t, p, "one" if t == 1 else "rest", 1e9 + t + p) for t in range(3) for p in range(5)] and all(0 <= r[4] <= 1 for r in got)


def test_sweep_text_rounds_numbers_as_they_are_in_binary(spark):
    values = [0.1252835, 0.1247475, -5e-7, -1e-7, 1.5e-6, 2.5e-6, 1999985000.0000005, 123456789012345.67, 0.0, math.nan, math.inf]
    s = spark.createDataFrame([("w", t, 0, v, -v, v, 0.1, 0.2) for t, v in enumerate(values)], "sweep_id string, tone int, point int, f double, i double, q double, ei double, eq double")
    assert text.sweep_text(s.repartition(3)).first().value == " ".join(f"{v:.6f} {-v:.6f} {v:.6f} 0.100000 0.200000" for v in values)


def test_cube(spark):
    import base64

    x = np.arange(24.0)
    enc = base64.b64encode(x.tobytes()).decode()
    df = spark.createDataFrame([("w", 2, 4, 3, enc, enc)], "sweep_id string, samples int, points int, tones int, data_i string, data_q string")
    assert all(r.i == r["sample"] * 12 + r.point * 3 + r.tone for r in text.decode_cubes(df).collect())


def test_calibration_and_tone_list(spark, folder):
    with open(f"{folder}/cal.txt", "w") as f:
        f.write("# note\nFrequency_Hz S21_dB\n1e6 -0.5\n\n 5e8\t-5.9\n")
    assert [(r.freq_hz, r.value_db) for r in text.read_calibration(spark, f"{folder}/cal.txt").orderBy("cal_order").collect()] == [(1e6, -0.5), (5e8, -5.9)]
    t = spark.createDataFrame([(0, 1.5e9), (1, 2.5e9)], "tone int, freq_hz double")
    text.write_tone_list(t, f"{folder}/list")
    part = next(x for x in os.listdir(f"{folder}/list") if x.startswith("part"))
    assert open(f"{folder}/list/{part}", "rb").read().startswith(b"Name\tFreq\tOffset att\tAll\tNone\r\nK000\t1500000000.000000\t0.000000\t1\t0\r\n")
    assert [r.freq_hz for r in text.read_tone_list(spark, f"{folder}/list").orderBy("name").collect()] == [1.5e9, 2.5e9]


def land(df, folder, name):
    os.makedirs(f"{folder}/in/s", exist_ok=True)
    with open(f"{folder}/in/s/{name}.tmp", "wb") as f:
        f.write(packed(df) + b"\0\0")
    os.rename(f"{folder}/in/s/{name}.tmp", f"{folder}/in/s/{name}.bin")


def test_stream_is_batch_over_restarts_and_repeats(spark, folder):
    df = make(spark, 60)
    gappy = df.where("seq NOT IN (10, 11, 40)")
    land(gappy.where("seq < 20"), folder, "a")
    open(f"{folder}/in/s/keepalive.bin", "wb").close()

    def run():
        q = counters.live_gaps(live.live_frames(spark, f"{folder}/in", 3)).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/cp").foreachBatch(lambda b, k: b.write.mode("append").json(f"{folder}/out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        r = live.record(live.live_frames(spark, f"{folder}/in", 3), f"{folder}/rec", f"{folder}/cp2")
        r.awaitTermination(120)

    run()
    land(gappy.where("seq >= 20"), folder, "b")
    land(gappy.where("seq >= 20 AND seq < 30"), folder, "c")
    run()
    last = spark.read.json(f"{folder}/out").orderBy(F.desc("n_frames")).first()
    assert (last.n_frames, last.n_gaps, last.n_missing) == (57, 2, 3)
    rec = spark.read.parquet(f"{folder}/rec")
    assert rows(rec.dropDuplicates(["packet_counter"]), COLS[1:]) == rows(gappy, COLS[1:])


def test_stream_errors_and_repeats(spark, folder):
    df = make(spark, 30, first=0)
    land(df, folder, "a")
    land(df.where("seq < 10"), folder, "b")
    f = live.with_event_time(live.live_frames(spark, f"{folder}/in", 3), "2024-01-01 00:00:00", 500.0)
    q = live.without_repeats(f).writeStream.format("memory").queryName("distinct_frames").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("distinct_frames").count() == 30
    e = live.running_errors(live.live_frames(spark, f"{folder}/in", 3)).writeStream.format("memory").outputMode("complete").queryName("errors").option("checkpointLocation", f"{folder}/cp3").trigger(availableNow=True).start()
    e.awaitTermination(120)
    got = spark.table("errors").first()
    assert got.n_frames == 40 and got.n_errors == ops.error_count(df).first().n_errors + ops.error_count(df.where("seq < 10")).first().n_errors


def board(n, first=0, step=1, seed=0, gaps=()):
    """(counter, error, i) of frames as a board gives them; no two runs of it have the same samples."""
    return [((first + step * k) % 2**32, int(k % 7 == 0), 1000 * seed + k) for k in range(n) if k not in gaps]


def land_frames(spark, folder, name, frames, stream="s"):
    rows = [(stream, k, c, e, [0] * 8, [i, i + 1], [-i, 0]) for k, (c, e, i) in enumerate(frames)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, packet_counter long, packet_error int, flags array<int>, i array<int>, q array<int>")
    os.makedirs(f"{folder}/in/{stream}", exist_ok=True)
    with open(f"{folder}/in/{stream}/{name}.tmp", "wb") as f:
        f.write(packed(df) + b"\0\0\0")
    os.rename(f"{folder}/in/{stream}/{name}.tmp", f"{folder}/in/{stream}/{name}.bin")


def test_live_counters_are_those_of_the_batch(spark, folder):
    """Three triggers with a restart of the query after each: gaps, a wrap, a restarted board, copies under other names, a
    file that lands late, and keep-alives."""
    def trigger():
        frames = live.live_frames(spark, f"{folder}/in", 2, records=16)
        for name, df, mode in (("gaps", counters.live_gaps(frames), "update"), ("times", counters.live_trigger_times(frames, 500.0), "append")):
            q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state-{name}").foreachBatch(lambda b, k, to=f"{folder}/{name}": b.write.mode("append").parquet(to)).trigger(availableNow=True).start()
            q.awaitTermination(120)

    def check():
        frames = spark.createDataFrame(sum(landed.values(), []), "stream_id string, chunk string, seq long, packet_counter long, packet_error int, flags array<int>, i array<int>, q array<int>")
        want = {r.stream_id: tuple(r) for r in counters.gap_figures(frames).collect()}
        got = {}
        for r in spark.read.parquet(f"{folder}/gaps").orderBy("n_frames").collect():
            got[r.stream_id] = tuple(r)
        assert got == want
        key = ["stream_id", "chunk", "seq", "packet_counter", "epoch", "counter64", "t"]
        assert rows(spark.read.parquet(f"{folder}/times"), key) == rows(counters.trigger_times(frames, 500.0), key)

    landed = {}

    def put(name, frames, stream="s"):
        land_frames(spark, folder, name, frames, stream)
        landed[stream, name] = [(stream, f"{name}.bin", k, c, e, [0] * 8, [i, i + 1], [-i, 0]) for k, (c, e, i) in enumerate(frames)]

    one = board(100, first=2**32 - 60, gaps=(10, 11, 70))
    put("c0", one[:50])
    put("c2", one[80:])
    put("x", board(5, step=40), "other")
    open(f"{folder}/in/s/c1-alive.bin", "wb").close()
    trigger()
    check()
    put("c1", one[50:80])  # late, between the two
    put("c3", board(500, seed=1))  # the board restarts
    trigger()
    check()
    put("c4", one[20:40])  # copies of what landed before, in part and whole
    put("c5", board(500, seed=1)[100:300])
    put("c6", board(50, first=500, seed=1))
    put("y", board(5, first=200, step=40, seed=2), "other")
    trigger()
    check()
    last = spark.read.parquet(f"{folder}/gaps").where("stream_id = 's'").orderBy(F.desc("n_frames")).first()
    assert (last.n_frames, last.n_gaps, last.n_missing, last.n_restarts) == (97 + 550, 2, 3, 1)


def test_folded_state_gives_the_same_and_counts_late_frames(spark, folder):
    def trigger():
        frames = live.live_frames(spark, f"{folder}/in", 2)
        q = counters.live_gaps(frames, delay="0.001 seconds").writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(lambda b, k: b.write.mode("append").parquet(f"{folder}/gaps")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    for k in range(4):
        land_frames(spark, folder, f"c{2 * k}", board(20, first=20 * k + (k > 1), seed=k))
        trigger()
    land_frames(spark, folder, "c1", board(7, first=3, seed=9))
    trigger()
    last = spark.read.parquet(f"{folder}/gaps").orderBy("n_frames", "n_late").collect()[-1]
    assert (last.n_frames, last.n_gaps, last.n_missing, last.n_restarts, last.n_late) == (80, 1, 1, 0, 7)


def test_recording_stream_reads_growing_and_large_chunks_once(spark, folder):
    frames = board(300)
    land_frames(spark, folder, "a", frames)

    def trigger():
        q = live.live_frames(spark, f"{folder}/in", 2, records=32, per_trigger=100).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.chunk, r.seq, r.packet_counter) for r in spark.read.parquet(f"{folder}/out").collect())

    assert trigger() == [("a.bin", k, k) for k in range(300)]
    data = open(f"{folder}/in/s/a.bin", "rb").read()
    with open(f"{folder}/in/s/a.bin", "ab") as f:  # the short record at the end is completed, and another one follows
        f.write(data[-3 - records.record_bytes(2) + 3 : -3][: records.record_bytes(2) - 3] + data[: records.record_bytes(2)])
    got = trigger()
    assert len(got) == 302 and got[-1][:2] == ("a.bin", 301)
    assert trigger() == got


def test_files_by_layouts_of_their_sidecars(spark, folder):
    """Files with permuted trailers, other words, planar tones and different widths in one call, and one without a sidecar."""
    import json

    rng = np.random.default_rng(2)
    want = []

    def put(name, tones, word, order, planar, n=40):
        i, q = (rng.integers(-100, 100, (n, tones)) for _ in range(2))
        trailer = {"index_cnt": np.arange(n), "index_err": rng.integers(0, 2, n), **{f"index_flag_{k}": rng.integers(0, 2, n) for k in range(8)}}
        z = np.concatenate([i, q], axis=1) if planar else np.stack([i, q], axis=2).reshape(n, -1)
        words = np.concatenate([z, np.stack([trailer[k] for k in order], axis=1)], axis=1).astype(word)
        with open(f"{folder}/{name}", "wb") as f:
            f.write(words.tobytes() + b"\1")
        said = {"num_tones": tones, "format": word, "ordering": "I_tone0, I_tone1, .. Q_tone0" if planar else "I_tone0_sample_0, Q_tone0_sample0, I_tone1_sample0", **{k: 2 * tones + at for at, k in enumerate(order)}}
        want.extend((name.removesuffix(".bin"), k, k, int(trailer["index_err"][k]), [int(trailer[f"index_flag_{j}"][k]) for j in range(8)], i[k].tolist(), q[k].tolist()) for k in range(n))
        return said

    plain = [*[f"index_flag_{k}" for k in range(8)], "index_cnt", "index_err"]
    for name, args in {"a": (3, "<i4", plain, False), "b.bin": (2, ">i2", plain[::-1], False), "c": (4, "<i8", plain[5:] + plain[:5], True)}.items():
        with open(f"{folder}/{name.removesuffix('.bin')}.json", "w") as f:
            json.dump(put(name, *args), f)
    got = records.read_recording(spark, folder, records=7)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    put("d", 5, "<i4", plain, False)
    assert sorted(map(tuple, records.read_recording(spark, folder, 5).collect())) == sorted(want)
    assert {tuple(map(len, (r.i, r.q))) for r in records.read_recording(spark, f"{folder}/c", keep=2).collect()} == {(2, 2)}


def test_recording_files_round_trip(spark, folder):
    both = make(spark, 50, 3, "x").union(make(spark, 20, 2, "y", first=5))
    records.write_recording_files(both, f"{folder}/r", {"sample_rate": 500.0})
    assert sorted(os.listdir(f"{folder}/r")) == ["x.bin", "x.json", "y.bin", "y.json"]
    assert open(f"{folder}/r/x.bin", "rb").read() == packed(both.where("stream_id = 'x'"))
    assert rows(records.read_recording(spark, f"{folder}/r"), ["stream_id", *COLS]) == rows(both, ["stream_id", *COLS])
    assert {(r.stream_id, r.num_tones, r.sample_rate) for r in records.sidecar(spark, f"{folder}/r/*.json").collect()} == {("x", 3, 500.0), ("y", 2, 500.0)}


def test_sinks_commit_whole_files_in_ranges(spark, folder, monkeypatch):
    from iqspark.sources import sinks

    monkeypatch.setattr(sinks, "RANGE", 10)
    lines = spark.range(1000).selectExpr("concat('f', id % 3) name", "id place", "concat('line ', id, '\n') value").repartition(7)
    sinks.write_files(lines, f"file://{folder}/out")
    for k in range(3):
        assert open(f"{folder}/out/f{k}").read() == "".join(f"line {x}\n" for x in range(k, 1000, 3))
    failing = lines.withColumn("value", F.expr("if(place = 777, raise_error('lost'), upper(value))"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_files(failing, f"{folder}/out")
    assert sorted(os.listdir(f"{folder}/out")) == ["f0", "f1", "f2"] and open(f"{folder}/out/f0").read().startswith("line 0")
    sinks.write_files(lines.where("place < 30"), f"{folder}/out")
    assert open(f"{folder}/out/f1").read() == "".join(f"line {x}\n" for x in range(1, 30, 3))
    with pytest.raises(Exception, match="no name of a file"):
        sinks.write_files(lines.withColumn("name", F.lit("../x")), f"{folder}/out")
    with pytest.raises(Exception, match="shared file system"):
        sinks.write_files(lines, "s3://bucket/x")


def test_headers_shape_what_is_read(spark, folder):
    a, b = make(spark, 30, 3, "a"), make(spark, 20, 12, "b")
    text.write_frames_csv(a, f"{folder}/f", None, {"date": "x", "sample_rate": 500.0}, "samples")
    text.write_frames_csv(b, f"{folder}/f", None, {"date": "y", "sample_rate": 250.0}, "stream")
    got = text.read_frames_csv(spark, f"{folder}/f")
    assert rows(got, ["stream_id", *COLS]) == rows(a.union(b), ["stream_id", *COLS])
    assert {(r.stream_id, r.date, r.sample_rate, len(r.tones)) for r in got.collect()} == {("a", "x", 500.0, 3), ("b", "y", 250.0, 12)}
    assert rows(text.read_samples_csv(spark, f"{folder}/f/a.csv"), COLS) == rows(a, COLS)
    two = long_sweep(spark).withColumn("sweep_id", F.when(F.col("tone") == 1, "v").otherwise("w"))
    text.write_sweep_csv(two, f"{folder}/s", None, {"num_points": 5})
    cols = ["sweep_id", "tone", "point", "f", "i", "q", "ei", "eq"]
    assert sorted(os.listdir(f"{folder}/s")) == ["v.csv", "w.csv"]
    assert rows(text.read_sweep_csv(spark, f"{folder}/s"), cols) == rows(two, cols)


def test_documents_of_two_streams_and_sweeps(spark, folder):
    import json

    both = make(spark, 30, 3, "x").union(make(spark, 20, 2, "y"))
    text.write_json_document(both, f"{folder}/j", None, {"sample_rate": 500.0})
    said = {n: json.load(open(f"{folder}/j/{n}.json")) for n in "xy"}
    assert (said["y"]["num_tones"], said["y"]["num_samples"], said["y"]["sample_rate"]) == (2, 20, 500.0)
    assert said["x"]["i_data"]["0002"] == [k * 2 - 5 for k in range(30)] and said["x"]["stream_flags"]["flag3"] == [k % 2 for k in range(30)]
    got = text.read_json_document(spark, f"{folder}/j")
    assert rows(got, ["stream_id", "seq", "packet_counter", "packet_error", "flags", "tone", "i", "q"])[0][0] == "x" and got.count() == 30 * 3 + 20 * 2
    two = long_sweep(spark).union(long_sweep(spark).withColumns({"sweep_id": F.lit("v"), "i": F.lit(float("nan"))}))
    text.write_sweep_document(two, f"{folder}/s", {"date": "x"})
    back = text.read_sweep_document(spark, f"{folder}/s")
    assert rows(back.where("sweep_id = 'w'"), ["tone", "point", "f", "i", "q"]) == rows(long_sweep(spark), ["tone", "point", "f", "i", "q"])
    assert back.where("sweep_id = 'v' AND i IS NULL").count() == 15


def test_calibration_order_is_that_of_the_files(spark, folder):
    os.makedirs(f"{folder}/cal")
    for name, n in (("a", 2), ("b", 4000)):
        with open(f"{folder}/cal/{name}.txt", "w") as f:
            f.write("# made\nfreq value\n" + "".join(f"{k}e3 {k}\n" for k in range(n)))
    got = [(r.freq_hz, r.value_db) for r in text.read_calibration(spark, f"{folder}/cal").orderBy("cal_order").collect()]
    assert got == [(k * 1e3, float(k)) for n in (2, 4000) for k in range(n)]


def test_what_a_run_wrote_can_be_removed(spark):
    from iqspark.sources import shared

    table = shared.stored(spark.range(5), "numbers")
    assert table.count() == 5 and shared.run_dir(spark).endswith(spark.sparkContext.applicationId)
    where = shared.run_dir(spark).removeprefix("file:")
    assert os.path.isdir(where)
    shared.remove_run(spark)
    assert not os.path.exists(where)
    assert shared.stored(spark.range(3), "numbers").count() == 3


def test_heads_without_meta_and_with_columns(spark, folder):
    s = long_sweep(spark)
    text.write_sweep_text(s, f"{folder}/t", {})
    assert open(f"{folder}/t/w.txt").readline().startswith("1000000000.000000 0.500000")
    both = make(spark, 4, 2, "x").withColumn("rate", F.lit(500.0)).union(make(spark, 3, 1, "y").withColumn("rate", F.lit(250.0)))
    text.write_frames_csv(both, f"{folder}/f", None, {"sample_rate": F.col("rate")})
    assert open(f"{folder}/f/x.csv").read().splitlines()[:2] == ["# sample_rate,500.0", "i_data_0000,q_data_0000,i_data_0001,q_data_0001," + ",".join(text.TRAIL)]
    assert {(r.stream_id, r.sample_rate, len(r.i)) for r in text.read_frames_csv(spark, f"{folder}/f").collect()} == {("x", 500.0, 2), ("y", 250.0, 1)}
    text.write_frames_csv(both, f"{folder}/g", None, {}, "stream")
    assert open(f"{folder}/g/y.csv").readline().startswith("packet_counter")
    tones = spark.createDataFrame([("a", 0, 1e9), ("b", 1, 2e9), ("b", 0, 1.5e9)], "tone_set string, tone int, freq_hz double")
    text.write_tone_list(tones, f"{folder}/l", "tones.txt", by_set=True)
    assert open(f"{folder}/l/b/tones.txt", newline="").read().count("\r\n") == 3


def test_payload_files(spark, folder, monkeypatch):
    import base64
    import json

    monkeypatch.setattr(text, "PIECE", 6)
    two = long_sweep(spark).union(long_sweep(spark).withColumns({"sweep_id": F.lit("v"), "i": F.col("i") + 1}).where("tone < 2"))
    text.write_sweep_payloads(two, f"{folder}/p", {"date": "x", "samples_per_point": 1})
    said = json.load(open(f"{folder}/p/v.json"))
    assert (said["num_tones"], said["num_points"]) == (2, 5) and len(base64.b64decode(said["sweep"]["f"])) == 80
    cols = ["sweep_id", "tone", "point", "f", "i", "q", "ei", "eq"]
    assert rows(text.read_sweep_payloads(spark, f"{folder}/p"), cols) == rows(two, cols)
