import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from iqspark.functions import fixedpoint, frequency, iq, powers
from iqspark.operators import frames, health, sweeps, tones
from iqspark.params import setting


def sweep(spark, z, f=None, tone=None):
    z = np.asarray(z, complex)
    f = np.arange(len(z)) * 1.0 if f is None else f
    rows = [("S", 0 if tone is None else tone[k], k, float(f[k]), float(z[k].real), float(z[k].imag), 0.1, 0.2) for k in range(len(z))]
    return spark.createDataFrame(rows, "sweep_id string, tone int, point int, f double, i double, q double, ei double, eq double")


def test_gradient_and_resonance_take_the_first_of_equal_maxima(spark):
    z = np.array([0, 1, 0, 1, 0, 1 + 1j])
    got = [r.grad for r in sweeps.with_gradient(sweep(spark, z)).orderBy("point").collect()]
    assert np.allclose(got, abs(np.gradient(z)))
    r = sweeps.retune(sweep(spark, z)).first()
    assert r.f_grad == np.argmax(abs(np.gradient(z))) and r.f_min == np.argmin(abs(z)) and r.f_resonance == r.f_grad
    one = sweeps.retune(sweep(spark, [1 + 2j]), "min_mag").first()
    assert one.f_resonance == 0.0
    with pytest.raises(Exception, match="unknown retune"):
        sweeps.retune(sweep(spark, z), "nothing").collect()


def test_least_magnitude_skips_nan(spark):
    assert sweeps.retune(sweep(spark, [float("nan"), 3, 1, 1]), "min_mag").first().f_resonance == 2.0


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_unwrap_in_both_forms_is_numpys_at_any_partitioning(spark, parts):
    rng = np.random.default_rng(3)
    phi = np.cumsum(rng.uniform(-2, 2, 300))
    tone = np.arange(300) // 30
    df = sweep(spark, np.exp(1j * phi), tone=tone.tolist()).repartition(parts)
    want = np.unwrap(np.angle(np.exp(1j * phi)))
    for form in (sweeps.unwrap, sweeps.unwrap_tones):
        got = [r.uphase for r in form(df).orderBy("tone", "point").collect()]
        assert np.allclose(got, want)


def test_half_turn_steps_are_left(spark):
    got = [r.uphase for r in sweeps.unwrap(sweep(spark, [-1, 1, -1])).orderBy("point").collect()]
    assert np.allclose(got, [math.pi, 0, math.pi])


def test_slope_on_uneven_steps_and_its_median(spark):
    f = np.cumsum([1, 2, 0.5, 3, 1, 1.5])
    phi = np.array([0, 0.3, 0.5, 1.1, 1.0, 1.4])
    s = sweeps.phase_slope(sweeps.unwrap(sweep(spark, np.exp(1j * phi), f)))
    assert np.allclose([r.slope for r in s.orderBy("point").collect()], np.gradient(phi, f))
    assert np.isclose(sweeps.median_slope(s).first().median_slope, np.nanmedian(np.gradient(phi, f)))
    rng = np.random.default_rng(2)
    values = [("a", float(x)) for x in rng.normal(size=5001)] + [("b", float(x)) for x in rng.integers(0, 3, 40)] + [("b", None), ("b", math.nan), ("c", 2.0)]
    got = {r.sweep_id: r.median_slope for r in sweeps.median_slope(spark.createDataFrame(values, "sweep_id string, slope double")).collect()}
    assert got == {k: float(np.nanmedian([v for n, v in values if n == k and v is not None])) for k in "abc"}
    f2 = np.cumsum(rng.uniform(0.5, 2, 24))
    z = np.exp(1j * np.cumsum(rng.uniform(-1, 1, 24)))
    tall = spark.createDataFrame([("s", k // 4, k % 4, float(f2[k]), float(z[k].real), float(z[k].imag)) for k in range(24)], "sweep_id string, tone int, point int, f double, i double, q double")
    assert np.allclose([r.slope for r in sweeps.phase_slope(sweeps.unwrap_tones(tall)).orderBy("tone", "point").collect()], np.gradient(np.unwrap(np.angle(z)), f2))
    twice = sweeps.phase_slope(sweeps.unwrap(sweep(spark, np.exp(1j * phi), np.array([1, 1, 2, 2, 3, 3.0]))))
    assert [r.slope for r in twice.orderBy("point").collect()][0] is None


def test_errors_have_a_literal_and_a_propagated_model(spark):
    row = sweeps.spectrum(sweep(spark, [3 + 4j])).first()
    assert math.isclose(row.elogmag, 20 / 5 / math.log(10) * math.hypot(3 * 0.1, 4 * 0.1) / 5)
    other = sweep(spark, [3 + 4j]).select(iq.magnitude_error(F.col("i"), F.col("q"), F.col("ei"), F.col("eq"), "propagated").alias("e")).first()
    assert math.isclose(other.e, math.hypot(3 * 0.1, 4 * 0.2) / 5)


def test_response_can_leave_out_errors(spark):
    df = spark.createDataFrame([("S", 0, 0, 0, 1.0, 2.0, 0), ("S", 1, 0, 0, 3.0, 4.0, 0), ("S", 2, 0, 0, 100.0, 0.0, 1)], "sweep_id string, sample int, point int, tone int, i double, q double, packet_error int")
    assert sweeps.response(df).first().n == 3
    r = sweeps.response(df, drop_errors=True).first()
    assert (r.i, r.q, r.ei) == (2.0, 3.0, 1.0)


def test_grids(spark):
    t = spark.createDataFrame([(0, 100.0)], "tone int, centre_hz double")
    for p in (1, 2, 5):
        want = np.linspace(95, 105, p)
        assert np.allclose([r.f for r in sweeps.grid(t, p, "up", 10.0).orderBy("point").collect()], want)
        assert np.allclose([r.f for r in sweeps.grid(t, p, "down", 10.0).orderBy("point").collect()], want[::-1])
    with pytest.raises(ValueError):
        sweeps.grid(t, 3, "sideways", 1.0)
    with pytest.raises(Exception, match="no span"):
        sweeps.grid(t, 3).collect()


def test_waveform_and_crest_factor(spark):
    t = spark.createDataFrame([("a", 0, 1.0, 0.5, 0.1), ("a", 1, 2.5, 1.0, 0.2)] + [("b", k, float(k), 1.0, 0.0) for k in range(600)], "tone_set string, tone int, freq_hz double, amplitude double, phase double")
    both = sweeps.waveform(t, 5000, 16.0)
    many = both.where("tone_set = 'b'").orderBy("sample").toPandas()
    assert np.allclose(many.i[:40], [sum(math.cos(2 * math.pi * f * k / 16) for f in range(600)) for k in range(40)])
    got = both.where("tone_set = 'a'").orderBy("sample").toPandas()
    k = np.arange(5000)
    want = 0.5 * np.exp(1j * (2 * np.pi * k / 16 + 0.1)) + np.exp(1j * (2 * np.pi * 2.5 * k / 16 + 0.2))
    assert np.allclose(got.i, want.real) and np.allclose(got.q, want.imag)


def counted(spark, counters):
    return spark.createDataFrame([("s", k, c, k % 2, [k // 2]) for k, c in enumerate(counters)], "stream_id string, seq long, packet_counter long, packet_error int, flags array<int>")


@pytest.mark.parametrize("bucket", [None, 2, 100])
def test_steps_wrap_and_gaps(spark, bucket):
    df = counted(spark, [2**32 - 2, 2**32 - 1, 0, 1, 5, 5])
    got = [r.step_mod for r in frames.counter_steps(df, bucket).orderBy("seq").collect()]
    assert got == [None, 1, 1, 1, 4, 0]
    r = frames.continuity(df, bucket).first()
    assert not r.contiguous and r.n_frames == 6
    assert frames.continuity(counted(spark, [7]), bucket).first().contiguous


def test_flag_intervals(spark):
    for bucket in (1, 2, 3, 100):
        got = sorted(tuple(r) for r in frames.flag_intervals(counted(spark, range(6)), 0, bucket).collect())
        assert got == [("s", 0, 0, 0, 1, 2), ("s", 0, 1, 2, 3, 2), ("s", 0, 2, 4, 5, 2)]
    rng = np.random.default_rng(3)
    values = [(int(k), [None if rng.random() < 0.1 else int(rng.integers(2)) for _ in range(2)]) for k in sorted(rng.choice(400, 150, False))]
    df = spark.createDataFrame([("s", k, v) for k, v in values], "stream_id string, seq long, flags array<int>")
    want = []
    for flag in (0, 1):
        for k, v in values:
            if want and want[-1][0] == flag and want[-1][1] == v[flag]:
                want[-1][3:] = [k, want[-1][4] + 1]
            else:
                want.append([flag, v[flag], k, k, 1])
    got = sorted([list(r)[1:] for r in frames.flag_intervals(df, bucket=16).collect()], key=lambda r: (r[0], r[2]))
    assert got == want


def test_headers_running_errors_and_first_counters(spark):
    df = counted(spark, [7, 9, 9, 12, 20])
    assert [r.n_errors for r in frames.running_errors(df, 2).orderBy("seq").collect()] == [0, 1, 1, 2, 2]
    assert [r.rebased for r in frames.rebased_counter(df).orderBy("seq").collect()] == [0, 2, 2, 5, 13]
    h = spark.createDataFrame([("s", 500.0, 1), ("s", 500.0, 1), ("t", 1.0, 2)], "stream_id string, sample_rate double, packet_error int")
    got = frames.with_header(df.unionByName(df.withColumn("stream_id", F.lit("u"))), h).collect()
    assert len(got) == 10 and {(r.stream_id, r.sample_rate, r.packet_error) for r in got} == {("s", 500.0, 1), ("u", None, None)}


def test_samples_and_frames_round_trip(spark):
    df = spark.createDataFrame([("s", 0, 9, [1, 2, 3], [4, 5, 6]), ("s", 1, 10, [7, 8, 9], [0, 1, 2])], "stream_id string, seq long, packet_counter long, i array<int>, q array<int>")
    assert sorted(map(tuple, frames.to_frames(frames.to_samples(df)).collect())) == sorted(map(tuple, df.collect()))
    assert frames.tone_series(df, 5).first().i is None


def test_half_even_words(spark):
    df = spark.createDataFrame([(x / 8,) for x in (0.5, 1.5, 2.5, -0.5, -1.5, 7.6, 9.0)], "x double")
    got = [r[0] for r in df.select(fixedpoint.amplitude_to_fixed(F.col("x"), 3)).collect()]
    assert got == [0, 2, 2, 0, -2, 7, 7]
    back = df.select(*fixedpoint.word_to_complex(fixedpoint.complex_to_word(F.col("x") / 2, F.col("x") / -2, 8), 8)).collect()
    assert all(abs(b[0] - min(r.x / 2, 127 / 128)) < 1 / 128 for b, r in zip(back, df.collect(), strict=True))
    cut = spark.createDataFrame([(-1.9 * math.pi / 4,)], "p double").select(fixedpoint.phase_to_fixed(F.col("p"), 2)).first()[0]
    assert cut == -1


def test_powers_round_trip(spark):
    df = spark.createDataFrame([(a,) for a in (1.0, 0.3, -0.2, 1.4)], "a double")
    c = powers.TxChain(psb_fftshift=0b1101, psb_scale=0.5, mixer_scale_is_1p0=False, mixer_qmc_gain=0.7, vop_current=10000, combiner_loss_db=-3, attenuator_db=12, rf_s21_db=4)
    for r in df.select("a", powers.tone_amplitude(powers.tone_power(F.col("a"), c), c).alias("b")).collect():
        assert math.isclose(r.b, abs(r.a), rel_tol=1e-9)
    rx = powers.RxChain(adc_dbm_to_dbfs=3.0, pfb_fftshift=7, acc_len=500, rx_mix_scale=0.25)
    for phase in (0.0, math.pi / 2, 0.4):
        i, q = powers.accumulated_level(F.lit(-20.0), rx, phase)
        assert math.isclose(spark.range(1).select(powers.adc_input_power(i, q, rx)).first()[0], -20.0)
    assert spark.range(1).select(powers.adc_input_power(F.lit(0.0), F.lit(0.0), rx)).first()[0] is None


def test_zones(spark):
    df = spark.createDataFrame([(1.2e9,)], "f double")
    for zone in (1, 2):
        bb = frequency.rf_to_baseband(F.col("f"), 1e9, zone, 4e9, -1)
        assert math.isclose(df.select(frequency.baseband_to_rf(bb, 1e9, zone, 4e9, -1)).first()[0], 1.2e9)
    with pytest.raises(Exception, match="Nyquist"):
        df.select(frequency.rf_to_baseband(F.col("f"), 0.0, 3)).collect()
    with pytest.raises(Exception, match="outside"):
        df.select(frequency.require_in_band(F.col("f"), 4096, 500e3)).collect()


def test_nearest_bin_is_the_exhaustive_one(spark):
    rng = np.random.default_rng(1)
    f = rng.uniform(-1.0e9, 1.0e9, 500)
    centres = np.fft.fftfreq(4096) * 2048e6
    df = spark.createDataFrame([(float(x),) for x in f], "f double")
    got = [r[0] for r in df.select(frequency.nearest_bin(F.col("f"), 4096)).collect()]
    assert got == [int(np.argmin(abs(x - centres))) for x in f]


def test_nearest_calibration_ties_and_the_large_form(spark, monkeypatch):
    rng = np.random.default_rng(5)
    cal = [(k, float(c), float(k)) for k, c in enumerate(rng.integers(0, 500, 400))]
    at = [(k, float(x)) for k, x in enumerate(np.concatenate([rng.uniform(-50, 550, 300), np.arange(0, 500, 0.5)[:300]]))]
    c = spark.createDataFrame(cal, "cal_order long, freq_hz double, value_db double")
    t = spark.createDataFrame(at, "tone int, freq_hz double")
    want = {k: min(cal, key=lambda r: (abs(r[1] - x), r[0]))[2] for k, x in at}
    assert {r.tone: r.value_db for r in tones.nearest_value(t, c).collect()} == want
    nothing = tones.nearest_value(t.union(spark.createDataFrame([(-1, None)], t.schema)), c).where("tone = -1").first()
    assert nothing.value_db is None and tones.nearest_value(t, c.limit(0)).where("value_db IS NOT NULL").count() == 0
    monkeypatch.setattr(tones, "TABLE_ROWS", 10)
    assert {r.tone: r.value_db for r in tones.nearest_value(t, c).collect()} == want


def large_calibration(spark):
    """6,000 entries 1.5 MHz apart, and 20,000 rows that are all near a few of them."""
    cal = spark.range(6000).select(F.col("id").alias("cal_order"), (F.lit(8.5e8) + F.col("id") * 1.5e6).alias("freq_hz"), (F.col("id") * 0.5).alias("value_db"))
    t = spark.range(20000).select(F.col("id").alias("tone"), F.when(F.col("id") < 19000, F.lit(9e8) + (F.col("id") % 1000) * 1e5).alias("freq_hz"))
    near = [min(range(30, 110), key=lambda o: (abs(8.5e8 + o * 1.5e6 - (9e8 + k * 1e5)), o)) * 0.5 for k in range(1000)]
    return t, cal, [near[k % 1000] if k < 19000 else None for k in range(20000)]


def carries_a_table(df):
    return "collect_list" in df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_near_one_part_of_a_large_calibration_carry_no_table(spark, monkeypatch):
    t, cal, want = large_calibration(spark)
    for rows in (tones.TABLE_ROWS, 10_000):  # by ranges, and by arrays
        monkeypatch.setattr(tones, "TABLE_ROWS", rows)
        out = tones.nearest_value(t, cal)
        assert not carries_a_table(out) and {r.tone: r.value_db for r in out.collect()} == dict(enumerate(want))


CHAIN = dict(psb_fftshift=0b1011, psb_scale=0.9, mixer_scale_is_1p0=True, mixer_qmc_gain=0.8, vop_current=18000.0)


def staged_by_a_large_calibration(spark):
    t, cal, want = large_calibration(spark)
    t = t.select("tone", F.col("freq_hz").alias("analog_hz"), F.col("freq_hz").alias("rf_hz"), ((F.col("tone") % 50 + 1) / 50).alias("amplitude"))
    return tones.with_stages(t, {"dac_dbfs_to_dbm": "S", "rf_s21_db": "S", "attenuator_db": 10}, {"S": cal}, cryostat=False), want


def test_powers_by_a_large_calibration(spark):
    """Two stages read one table at frequencies near a few of its entries: rows carry no table between them."""
    staged, want = staged_by_a_large_calibration(spark)
    out = tones.tone_powers(staged, CHAIN)
    assert not carries_a_table(out)
    bare = powers.TxChain(**CHAIN)
    flat = {r.tone: r.p for r in staged.select("tone", powers.tone_power(F.col("amplitude"), bare).alias("p")).collect()}
    none = spark.range(1).select(powers.tone_power(F.lit(1.0), bare) - powers.tone_power(F.lit(1.0), powers.TxChain(**CHAIN, dac_dbfs_to_dbm=0.0, attenuator_db=10))).first()[0]
    got = {r.tone: r.power_dbm for r in out.collect()}
    assert got.keys() == flat.keys() and all(got[k] is None if w is None else math.isclose(got[k], flat[k] - none + 2 * w, abs_tol=1e-9) for k, w in enumerate(want))


def test_amplitudes_by_a_large_calibration_give_the_powers_back(spark):
    staged, want = staged_by_a_large_calibration(spark)
    asked = staged.withColumn("power_dbm", F.col("amplitude") * 40 - 100).drop("amplitude")
    out = tones.tone_amplitudes(asked, CHAIN)
    assert not carries_a_table(out)
    got = {r.tone: (r.p, r.power_dbm) for r in tones.tone_powers(out.withColumnRenamed("power_dbm", "p"), CHAIN).collect()}
    assert len(got) == len(want) and all((got[k][1] is None) if w is None else math.isclose(*got[k], abs_tol=1e-9) for k, w in enumerate(want))


def test_calibration_specs(spark):
    t = spark.createDataFrame([(0, 5.0)], "tone int, freq_hz double")
    value = lambda spec, **k: tones.calibration_value(t, spec, **k).first().value_db
    assert (value(None), value(3), value("-6.5"), value([["1e0", "2"], ["5e0", "-7"]]), value(3, connected=False)) == (0.0, 3.0, -6.5, -7.0, 0.0)


def test_tone_sets(spark):
    t = spark.createDataFrame([("a", 0, 1.0, 1.0), ("a", 1, 2.0, 0.5), ("a", 2, 3.0, 0.25), ("b", 3, 9.0, 1.0)], "tone_set string, tone int, freq_hz double, amplitude double")
    got = {r.tone: r.phase for r in tones.newman_phases(t).collect()}
    assert math.isclose(got[2], math.pi * 4 / 3) and got[3] is None
    assert {r.tone_set: r.even for r in tones.spacing(t, 1.0).collect()} == {"a": True, "b": None}
    assert sorted(round(r.att_db, 6) for r in tones.attenuations(t).where("tone_set = 'a'").collect()) == [0.0, 6.0206, 12.0412]


def test_saturation_headroom(spark):
    df = spark.createDataFrame([("r", 32767, 0)], "run string, i int, q int")
    assert not health.saturation(df, "run").first().saturated
    assert health.saturation(df, "run", headroom_lsb=1).first().saturated


def test_restore(spark):
    now = spark.createDataFrame([(0, 10.4), (1, 99.0)], "tone int, freq_hz double")
    c = spark.createDataFrame([(0, 10.0, 1.0), (1, 20.0, 1.0)], "tone int, centre_hz double, span_hz double")
    assert sorted(r.freq_hz for r in sweeps.restore_frequencies(now, c).collect()) == [10.4, 20.0]
    assert sorted(r.freq_hz for r in sweeps.restore_frequencies(now.limit(1), c).collect()) == [10.0, 20.0]


def test_settings_read_numbers_and_aliases():
    config = {"firmware": {"adc_ddc_mix_frequency_hz": "0.5e9", "frequencies": ["1e6", 2], "cal": None}}
    assert setting(config, "firmware", "adc_ddc_mixer_frequency_hz") == 0.5e9
    assert setting(config, "firmware", "tone_frequencies") == [1e6, 2]
    assert setting(config, "firmware", "cal", default=0) == 0


def epochs_by_hand(counters, most_step):
    """(epoch, 64-bit counter, counter since the epoch's first) of each counter in turn."""
    out, epoch, wraps, start = [], 0, 0, counters[0] if counters else 0
    for k, c in enumerate(counters):
        if k:
            step = (c - counters[k - 1]) % 2**32
            if step > most_step:
                epoch, wraps, start = epoch + 1, 0, c
            elif c < counters[k - 1]:
                wraps += 1
        out.append((epoch, c + wraps * 2**32, c + wraps * 2**32 - start))
    return out


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_epochs_over_wraps_and_restarts(spark, parts):
    from iqspark.operators import epochs

    rng = np.random.default_rng(parts)
    step = 2**30
    counters = [(2**32 - 5 + 3 * k) % 2**32 for k in range(40)]  # a wrap
    counters += [7 + k * (step - 9) % 2**32 for k in range(30)]  # a restart, then many wraps
    counters += [0, 0, 1, 5, 2**32 - 1, 3, 4]  # a restart, a repeat, a restart, a wrap: all in one range
    for _ in range(20):
        at = int(rng.integers(0, 2**32))
        for s in rng.integers(0, step, 15):
            counters.append(at := (at + int(s)) % 2**32)
    want = epochs_by_hand(counters, step)
    rows = [("a", 7 * k, c) for k, c in enumerate(counters)] + [("b", k, k) for k in range(3)]
    frames = spark.createDataFrame(rows, "stream_id string, seq long, packet_counter long").repartition(parts)
    for bucket in (1, 50, 65_536):
        got = sorted((r.seq, r.epoch, r.counter64, r.rebased) for r in epochs.with_epochs(frames, step, bucket).where("stream_id = 'a'").collect())
        assert got == [(7 * k, *w) for k, w in enumerate(want)]
    assert epochs.with_epochs(frames.limit(0)).count() == 0
    assert {tuple(r) for r in epochs.epoch_ranges(epochs.with_epochs(frames)).where("stream_id = 'b'").collect()} == {("b", 0, 0, 2, 3, 2)}


def test_time_and_continuity_over_a_wrap_and_a_restart(spark):
    counters = [2**32 - 2, 2**32 - 1, 0, 3, 0, 1, 2]
    rows = spark.createDataFrame([("a", k, c) for k, c in enumerate(counters)], "stream_id string, seq long, packet_counter long")
    assert [r.t for r in frames.counter_time(rows, 2.0).orderBy("seq").collect()] == [0.0, 0.5, 1.0, 2.5, 0.0, 0.5, 1.0]
    r = frames.continuity(rows, 3).first()
    assert (r.n_frames, r.contiguous, r.n_missing, r.n_restarts) == (7, False, 2, 1)


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_slopes_by_frequency_are_those_of_numpy(spark, parts):
    rng = np.random.default_rng(9)
    n = 300
    f = rng.permutation(np.cumsum(rng.uniform(0.5, 2, n)))
    tone = rng.integers(0, 4, n)  # tones overlap
    z = np.exp(1j * (f * 0.9 + rng.normal(0, 0.3, n)))
    got = {r.point: (r.uphase, r.slope) for r in sweeps.frequency_slopes(sweep(spark, z, f, tone.tolist()).repartition(parts), rows=n // parts).collect()}
    order = np.argsort(f)
    phase = np.unwrap(np.angle(z[order]))
    slope = np.gradient(phase, f[order])
    assert all(np.allclose(got[int(k)], (phase[at], slope[at])) for at, k in enumerate(order))


def orders_of_one_table(spark, folder):
    """Two copies of a lineitem table. Tone 1 has the means 0 and 2^-50 / 6, as 0.07 * 100 is over 7; added up in order, that is
    lost behind a sum of 10, in copy a."""
    rows = [(1, 1, 25.0 + k % 2, x) for k, x in enumerate([0.10, 0.10, 0.07, 0.01, 0.01, 0.01])]
    others = [(0, 1, 30.0, 0.02), (2, 1, 20.0, 0.03), (3, 2, 31.0, 0.09)]
    for name, order in (("a", [0, 1, 2, 3, 4, 5]), ("b", [2, 3, 4, 0, 5, 1])):
        table = spark.createDataFrame([rows[k] for k in order] + others, "l_suppkey long, l_linenumber int, l_quantity double, l_discount double")
        table.coalesce(1).write.parquet(f"{folder}/{name}/lineitem.parquet")
        yield f"{folder}/{name}"


def test_phases_do_not_hang_on_the_order_of_samples(spark, folder):
    from iqspark.plans.queries import QUERIES

    got = [sorted(map(tuple, QUERIES["w6_unwrap_two_pass"](spark, d).collect())) for d in orders_of_one_table(spark, folder)]
    assert got[0] == got[1] and ("L", 1, 0, 1.570796) in [r[:4] for r in got[0]]


def test_slopes_by_frequency_do_not_hang_on_the_order_of_samples(spark, folder):
    from iqspark.plans.queries import QUERIES

    got = [sorted(map(tuple, QUERIES["w6_w7_by_frequency"](spark, d).collect())) for d in orders_of_one_table(spark, folder)]
    assert got[0] == got[1] and ("L", 1, 0, 1.570796) in [r[:4] for r in got[0]]


@pytest.mark.parametrize("parts", [1, 5])
def test_exact_means(spark, parts):
    from fractions import Fraction

    rng = np.random.default_rng(8)
    groups = {"a": rng.integers(1, 11, 3000) / 100 * 100 - 5, "b": rng.normal(size=2000) * 10.0 ** rng.integers(-6, 6, 2000), "c": np.array([1e15, 1.0, -1e15]), "d": np.array([0.1] * 1000), "e": np.array([np.inf, 1.0]), "f": np.array([np.nan, 1.0]), "g": np.array([-0.0])}
    values = [(g, float(x)) for g, v in groups.items() for x in v]
    got = []
    for order in (range(len(values)), rng.permutation(len(values))):
        df = spark.createDataFrame([values[k] for k in order] + [("h", None), ("d", None)], "g string, x double").repartition(parts)
        got.append({r.g: r.m for r in df.groupBy("g").agg(iq.exact_mean("x").alias("m")).collect()})
    assert repr(sorted(got[0].items())) == repr(sorted(got[1].items())) and got[0]["h"] is None
    for g in "abd":
        assert math.isclose(got[0][g], float(sum(map(Fraction, groups[g])) / len(groups[g])), rel_tol=4e-16)
    assert got[0]["e"] == math.inf and math.isnan(got[0]["f"])


def test_median_of_equal_slopes_is_one_counted_row(spark):
    rng = np.random.default_rng(1)
    values = {"a": [7.0] * 100_000 + [1.0] * 10 + [9.0] * 7, "b": rng.normal(0, 1, 20_001).tolist(), "c": [1.0, 2.0, float("nan"), None], "d": [3.0] * 5 + [4.0] * 5}
    slopes = spark.createDataFrame([(k, v) for k, x in values.items() for v in x], "sweep_id string, slope double")
    got = {r.sweep_id: r.median_slope for r in sweeps.median_slope(slopes).collect()}
    assert got == {k: float(np.nanmedian(np.array(x, float))) for k, x in values.items()}
    assert sweeps.median_slope(slopes.limit(0)).count() == 0


def test_bitmaps_of_landed_places_merge(spark):
    rng = np.random.default_rng(3)
    points, tones = 1000, 70  # three buckets
    places = [(int(k) // points, int(k) % points) for k in rng.permutation(points * tones)[:60_000]]
    rows = spark.createDataFrame([("s", t, p) for t, p in places] + [("t", 0, 0), ("t", 69, 999), ("t", 70, 0), ("t", 0, 1000)], "sweep_id string, tone int, point int")
    halves = [sweeps.landed_bitmaps(rows.where(f"point % 2 = {k}").union(rows.where("tone = 3")), points, tones) for k in (0, 1)]
    merged = sweeps.merge_bitmaps(*halves)
    got = {r.sweep_id: (r.n_landed, r.complete) for r in sweeps.landed(merged, points, tones).collect()}
    assert got == {"s": (60_000, False), "t": (2, False)}
    missing = {(r.tone, r.point) for r in sweeps.missing_places(merged, points, tones).where("sweep_id = 's'").collect()}
    assert missing == {(t, p) for t in range(tones) for p in range(points)} - set(places)
    assert sweeps.missing_places(merged, points, tones).where("sweep_id = 't'").count() == points * tones - 2
    whole = spark.range(6).selectExpr("'w' sweep_id", "cast(id div 3 as int) tone", "cast(id % 3 as int) point")
    assert sweeps.landed(sweeps.landed_bitmaps(whole, 3, 2), 3, 2).first().complete


def test_recording_meets_its_points(spark):
    frames_ = spark.createDataFrame([("r", c, int(c % 10 == 3), [c, 2 * c], [0, 1]) for c in range(9000) if c % 7], "stream_id string, counter64 long, packet_error int, i array<int>, q array<int>")
    points = spark.createDataFrame([("s", "r", 0, 10, 19), ("s", "r", 1, 15, 30), ("s", "r", 2, 100, 8999), ("s", "r", 3, 20_000, 20_010), ("s", "other", 4, 0, 10)], "sweep_id string, stream_id string, point int, first_counter long, last_counter long")
    got = sorted((r.point, r.sample, r.tone, r.i) for r in sweeps.samples_of_points(frames_, points).collect())
    want = sorted((p, c - a, t, float(c * (t + 1))) for p, a, b in ((0, 10, 19), (1, 15, 30), (2, 100, 8999)) for c in range(a, b + 1) if c % 7 for t in range(2))
    assert got == want
    clean = sweeps.response(sweeps.samples_of_points(frames_, points), drop_errors=True).where("point = 0 AND tone = 0").first()
    assert clean.n == len([c for c in range(10, 20) if c % 7 and c % 10 != 3])
    raw = spark.createDataFrame([("s", k, 0, 0, float(k), 0.0) for k in range(4)], "sweep_id string, sample int, point int, tone int, i double, q double")
    acc = spark.createDataFrame([("s", k, 0, 100 + k, int(k == 2)) for k in range(3)], "sweep_id string, sample int, point int, acc_count long, acc_err int")
    assert sweeps.response(sweeps.with_accumulations(raw, acc), drop_errors=True).first().i == (0 + 1 + 3) / 3


def test_differences_count_repeated_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z"), (3, None)], "k int, v string")
    same = frames.differences(a, a.repartition(3), ["k"], ["v"]).first()
    assert (same.n, same.n_different, same.equal) == (5, 0, True)
    b = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "w"), (4, "q")], "k int, v string")
    r = frames.differences(a, b, ["k"], ["v"]).first()
    assert (r.n, r.n_different, r.equal) == (6, 4, False)
    assert frames.differences(a.limit(0), b.limit(0), ["k"], ["v"]).first().equal


def test_of_several_headers_the_first_is_taken(spark):
    rows = spark.createDataFrame([("a", 1)], "stream_id string, seq long")
    heads = spark.createDataFrame([("a", 2, {"x": "2"}), ("a", 1, {"x": "1"})], "stream_id string, rate int, info map<string,string>")
    assert all(frames.with_header(rows, heads.repartition(n)).first().rate == 1 for n in (1, 2, 5))
