"""Registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixedpoint, frequency, iq, powers
from ..operators import frames, health, sweeps, tones
from ..sources import records, text
from . import inputs
from .inputs import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PI = "pi()"


def _with(names: str, query: str) -> str:
    return "WITH " + ", ".join(SQL[n] if n in SQL else n for n in names.split(" | ")) + " " + query


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rnd(c: Column | str, k: int = 6) -> Column:
    """Rounded for comparison, without negative zeros."""
    return F.round(c, k) + F.lit(0.0)


def r(x: str, k: int = 6) -> str:
    return f"(round({x}, {k}) + 0.0)"


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: rnd(c, k) for c, k in places.items()})


RESP_E = "resp AS (SELECT sweep_id, tone, point, any_value(f) AS f, avg(i) AS i, avg(q) AS q, stddev_pop(i) AS ei, stddev_pop(q) AS eq, count(*) AS n FROM e GROUP BY sweep_id, tone, point)"
RESP_L = RESP_E.replace("FROM e ", "FROM l ")
GRAD = """g0 AS (SELECT *, lag(i) OVER w AS i0, lead(i) OVER w AS i1, lag(q) OVER w AS q0, lead(q) OVER w AS q1 FROM resp WINDOW w AS (PARTITION BY sweep_id, tone ORDER BY point)),
g AS (SELECT *, sqrt(pow(coalesce((i1-i0)/2, i1-i, i-i0, 0), 2) + pow(coalesce((q1-q0)/2, q1-q, q-q0, 0), 2)) AS grad FROM g0)"""
# Neighbouring gradients of equal size on both engines differ in the last bit, so ties are settled after rounding.
UNWRAP = f"""ph AS (SELECT *, atan2(q, i) AS phase FROM resp),
k AS (SELECT *, CASE WHEN phase - lag(phase) OVER w > {PI} THEN -1 WHEN phase - lag(phase) OVER w < -{PI} THEN 1 ELSE 0 END AS k FROM ph WINDOW w AS (PARTITION BY sweep_id ORDER BY tone, point)),
u AS (SELECT *, phase + 2*{PI}*sum(k) OVER (PARTITION BY sweep_id ORDER BY tone, point) AS uphase FROM k)"""
SLOPE = """h AS (SELECT *, f - lag(f) OVER w AS hs, lead(f) OVER w - f AS hd, lag(uphase) OVER w AS u0, lead(uphase) OVER w AS u1 FROM u WINDOW w AS (PARTITION BY sweep_id ORDER BY tone, point)),
sl AS (SELECT *, CASE WHEN hs IS NULL OR hd IS NULL THEN coalesce((u1-uphase)/nullif(hd,0), (uphase-u0)/nullif(hs,0)) ELSE (hs*hs*u1 + (hd*hd-hs*hs)*uphase - hd*hd*u0)/nullif(hs*hd*(hd+hs),0) END AS slope FROM h)"""


def _response(samples: DataFrame, mean: Callable[[str], Column] = F.avg) -> DataFrame:
    """A sweep's response with its frequencies (each tone and point has one)."""
    f = samples.groupBy("sweep_id", "tone", "point").agg(F.min("f").alias("f"), mean("i").alias("i"), mean("q").alias("q"), F.stddev_pop("i").alias("ei"), F.stddev_pop("q").alias("eq"), F.count("*").alias("n"))
    return f


@register(_with(f"e | {RESP_E}", f"SELECT sweep_id, tone, point, {r('i')} AS i, {r('q')} AS q, {r('ei')} AS ei, {r('eq')} AS eq, n FROM resp"))
def a1_a2_sweep_response(spark, d):
    return _rounded(sweeps.response(inputs.sweep_e(spark, d)), i=6, q=6, ei=6, eq=6)


@register(_with(f"l | {RESP_L}", f"SELECT sweep_id, tone, point, {r('i')} AS i, {r('q')} AS q, {r('ei')} AS ei, {r('eq')} AS eq, n FROM resp"))
def a1_a2_sweep_response_lineitem(spark, d):
    return _rounded(sweeps.response(inputs.sweep_l(spark, d), drop_errors=True), i=6, q=6, ei=6, eq=6)


def _retuned(samples: DataFrame) -> DataFrame:
    return sweeps.retune(_response(samples)).select("sweep_id", "tone", "f_grad", "f_min")


_RETUNE = "SELECT sweep_id, tone, arg_max(f, (grad, -point)) AS f_grad, arg_min(f, (sqrt(i*i+q*q), point)) AS f_min FROM g GROUP BY sweep_id, tone"


@register(_with(f"e | {RESP_E} | {GRAD}", _RETUNE))
def wf2_retune_embeddings(spark, d):
    return _retuned(inputs.sweep_e(spark, d))


@register(_with(f"l | {RESP_L} | {GRAD}", _RETUNE))
def w4_w5_retune_lineitem(spark, d):
    return _retuned(inputs.sweep_l(spark, d))


@register(_with(f"e | {RESP_E} | {GRAD}", f"SELECT sweep_id, tone, point, {r('grad')} AS grad FROM g"))
def w3_gradient(spark, d):
    return sweeps.with_gradient(_response(inputs.sweep_e(spark, d))).select("sweep_id", "tone", "point", rnd("grad").alias("grad"))


_UNWRAPPED = f"SELECT sweep_id, tone, point, {r('phase')} AS phase, {r('uphase')} AS uphase FROM u"


@register(_with(f"e | {RESP_E} | {UNWRAP}", _UNWRAPPED))
def w6_unwrap(spark, d):
    return sweeps.unwrap(_response(inputs.sweep_e(spark, d))).select("sweep_id", "tone", "point", rnd("phase").alias("phase"), rnd("uphase").alias("uphase"))


@register(_with(f"l | {RESP_L} | {UNWRAP}", _UNWRAPPED))
def w6_unwrap_two_pass(spark, d):
    return sweeps.unwrap_tones(_response(inputs.sweep_l(spark, d), iq.exact_mean)).select("sweep_id", "tone", "point", rnd("phase").alias("phase"), rnd("uphase").alias("uphase"))


@register(_with(f"e | {RESP_E} | {UNWRAP} | {SLOPE}", f"SELECT sweep_id, tone, point, {r('slope*1e6')} AS slope FROM sl"))
def w7_phase_slope(spark, d):
    out = sweeps.phase_slope(sweeps.unwrap_tones(_response(inputs.sweep_e(spark, d))))
    return out.select("sweep_id", "tone", "point", rnd(F.col("slope") * 1e6).alias("slope"))


@register(_with(f"e | {RESP_E} | {UNWRAP} | {SLOPE}", f"SELECT sweep_id, {r('quantile_cont(slope, 0.5)*1e6')} AS median_slope FROM sl WHERE slope IS NOT NULL GROUP BY sweep_id"))
def a9_median_slope(spark, d):
    return _rounded(sweeps.median_slope(sweeps.phase_slope(sweeps.unwrap_tones(_response(inputs.sweep_e(spark, d))))).withColumn("median_slope", F.col("median_slope") * 1e6), median_slope=6)


#: Sweep L with tones that overlap: 35 kHz apart, and seven points of 10 kHz; no two points have one frequency.
_OVERLAP = RESP_L.replace("any_value(f) AS f", "1e9 + tone*35000 + point*10000 AS f")
_BY_F = [x.replace("ORDER BY tone, point", "ORDER BY f") for x in (UNWRAP, SLOPE)]


@register(_with(f"l | {_OVERLAP} | {_BY_F[0]} | {_BY_F[1]}", f"SELECT sweep_id, tone, point, {r('uphase')} AS uphase, {r('slope*1e6')} AS slope FROM sl"))
def w6_w7_by_frequency(spark, d):
    """A sweep flattened in order of frequency, in ranges of 1,000 rows."""
    resp = _response(inputs.sweep_l(spark, d), iq.exact_mean).withColumn("f", F.lit(1e9) + F.col("tone") * 35000.0 + F.col("point") * 10000.0)
    out = sweeps.frequency_slopes(resp, 1000)
    return out.select("sweep_id", "tone", "point", rnd("uphase").alias("uphase"), rnd(F.col("slope") * 1e6).alias("slope"))


_POINTS = "dwell AS (SELECT point, point * 20 AS first_counter, point * 20 + 14 AS last_counter FROM (SELECT DISTINCT packet_counter // 20 AS point FROM fr))"


@register(_with(f"fr | {_POINTS}", f"SELECT 'W' AS sweep_id, t::INT AS tone, point, {r('avg(i[t+1])')} AS i, {r('avg(q[t+1])')} AS q, {r('stddev_pop(i[t+1])', 3)} AS ei, count(*) AS n FROM fr JOIN dwell ON packet_counter BETWEEN first_counter AND last_counter, range(32) r(t) WHERE packet_error = 0 GROUP BY t, point"))
def wf2_recording_to_sweep(spark, d):
    """Frames E as a recording of a sweep that dwells for 15 counts at each point, with 5 between: its response, without
    frames that have an error."""
    fr = inputs.frames_e(spark, d).withColumn("counter64", F.col("packet_counter"))
    point = F.floor(F.col("packet_counter") / 20)
    points = fr.select("stream_id", point.alias("point")).distinct().select(F.lit("W").alias("sweep_id"), "stream_id", "point", (F.col("point") * 20).alias("first_counter"), (F.col("point") * 20 + 14).alias("last_counter"))
    out = sweeps.response(sweeps.samples_of_points(fr, points), drop_errors=True)
    return out.select("sweep_id", "tone", "point", rnd("i").alias("i"), rnd("q").alias("q"), rnd("ei", 3).alias("ei"), "n")


@register(_with("l", "SELECT sweep_id, count(DISTINCT (tone, point)) AS n_landed, count(DISTINCT (tone, point)) / 10007.0 AS share, count(DISTINCT (tone, point)) = 10007.0 AS complete FROM l WHERE sample % 211 < 2 GROUP BY sweep_id").replace("AS f FROM lineitem", "AS f, l_orderkey AS sample FROM lineitem").replace("10007.0", "(7 * (SELECT max(l_suppkey) + 1.0 FROM lineitem))"))
def a10_landed_bitmaps(spark, d):
    """Samples of some orders, in two batches whose bitmaps are merged."""
    samples = inputs.table(spark, d, "lineitem").select(F.lit("L").alias("sweep_id"), F.col("l_suppkey").cast("int").alias("tone"), (F.col("l_linenumber") - 1).cast("int").alias("point"), F.col("l_orderkey").alias("sample")).where("sample % 211 < 2")
    tones = inputs.table(spark, d, "lineitem").agg(F.max("l_suppkey")).first()[0] + 1
    halves = [sweeps.landed_bitmaps(samples.where(f"sample % 2 = {k}"), 7, tones) for k in (0, 1)]
    return sweeps.landed(sweeps.merge_bitmaps(*halves), 7, tones)


@register("WITH k AS (SELECT l_suppkey::INT AS tone, (l_linenumber - 1)::INT AS point FROM lineitem WHERE l_orderkey % 211 < 2) SELECT 'L' AS sweep_id, t::INT AS tone, p::INT AS point FROM range((SELECT max(l_suppkey) + 1 FROM lineitem)) a(t), range(7) b(p) WHERE (t, p) NOT IN (SELECT (tone, point) FROM k)")
def a10_missing_places(spark, d):
    line = inputs.table(spark, d, "lineitem")
    samples = line.where("l_orderkey % 211 < 2").select(F.lit("L").alias("sweep_id"), F.col("l_suppkey").cast("int").alias("tone"), (F.col("l_linenumber") - 1).cast("int").alias("point"))
    tones = line.agg(F.max("l_suppkey")).first()[0] + 1
    return sweeps.missing_places(sweeps.landed_bitmaps(samples, 7, tones), 7, tones)


_FLIP = "fl AS (SELECT sweep_id, tone, point, f, ei, eq, CASE WHEN ((b % 2) + 2) % 2 = 1 THEN -i ELSE i END AS i, CASE WHEN ((b % 2) + 2) % 2 = 1 THEN -q ELSE q END AS q FROM (SELECT *, round_even((4e9-f-1024e6)/1024e6*4096, 0) AS b FROM resp))"
_ROT = _with(f"e | {RESP_E} | {_FLIP} | {UNWRAP.replace('FROM resp)', 'FROM fl)')} | {SLOPE} | m AS (SELECT sweep_id, quantile_cont(slope, 0.5) AS ms FROM sl WHERE slope IS NOT NULL GROUP BY sweep_id) | rt AS (SELECT sweep_id, tone, point, f, ei, eq, i*cos(th)+q*sin(th) AS i, q*cos(th)-i*sin(th) AS q FROM (SELECT fl.*, round(ms*1e9, 3)/1e9*f+{PI} AS th FROM fl JOIN m USING (sweep_id)))", "")


def _derotated(spark, d) -> DataFrame:
    """Flip, unwrap, slope, rotation. The median is rounded, as it is multiplied by frequencies of 1e9."""
    resp = _response(inputs.sweep_e(spark, d)).drop("n")
    flipped = sweeps.flip_odd_bins(resp)
    median = sweeps.median_slope(sweeps.phase_slope(sweeps.unwrap_tones(flipped))).withColumn("median_slope", F.round(F.col("median_slope") * 1e9, 3) / 1e9)
    return sweeps.remove_slope(flipped, median)


@register(_ROT + f"SELECT sweep_id, tone, point, {r('20*log10(sqrt(i*i+q*q))')} AS logmag, {r('20/ln(10)/sqrt(i*i+q*q)*(sqrt(i*ei*i*ei+q*ei*q*ei)/sqrt(i*i+q*q))')} AS elogmag, {r('sqrt(q*ei*q*ei+i*eq*i*eq)/(i*i+q*q)')} AS ephi FROM rt")
def wf3_spectrum(spark, d):
    return _rounded(sweeps.spectrum(_derotated(spark, d)).select("sweep_id", "tone", "point", "logmag", "elogmag", "ephi"), logmag=6, elogmag=6, ephi=6)


@register(_ROT + f"SELECT sweep_id, tone, point, {r('i', 5)} AS i, {r('q', 5)} AS q FROM rt")
def m19_m20_derotate(spark, d):
    return _rounded(_derotated(spark, d).select("sweep_id", "tone", "point", "i", "q"), i=5, q=5)


@register(_with(f"e | {RESP_E}", f"SELECT sweep_id, {r('min(20*log10(sqrt(i*i+q*q)))')} AS min_db, {r('max(20*log10(sqrt(i*i+q*q)))')} AS max_db, {r('min(atan2(q,i))')} AS min_phase, {r('max(atan2(q,i))')} AS max_phase FROM resp WHERE f > 2.004e9 AND f < 2.020e9 GROUP BY sweep_id"))
def p11_zoom(spark, d):
    return _rounded(sweeps.zoom(_response(inputs.sweep_e(spark, d)), 2.004e9, 2.020e9), min_db=6, max_db=6, min_phase=6, max_phase=6)


@register(_with(f"e | {RESP_E}", f"SELECT sweep_id, {r('min(20*log10(sqrt(i*i+q*q)))')} AS low, {r('max(20*log10(sqrt(i*i+q*q)))')} AS high FROM resp GROUP BY sweep_id"))
def a14_axis_limits(spark, d):
    return _rounded(sweeps.axis_limits(sweeps.spectrum(_response(inputs.sweep_e(spark, d)))), low=6, high=6)


@register(_with("e", f"SELECT sample, tone, {r('sqrt(i*i+q*q)')} AS mag, {r('20*log10(sqrt(i*i+q*q))')} AS db, {r('atan2(q,i)')} AS phase FROM e"))
def p5_p6_p7_polar(spark, d):
    i, q = F.col("i"), F.col("q")
    return inputs.sweep_e(spark, d).select("sample", "tone", rnd(iq.magnitude(i, q)).alias("mag"), rnd(iq.log_magnitude(i, q)).alias("db"), rnd(iq.angle(i, q)).alias("phase"))


@register(_with("e", f"SELECT sample, tone, {r(f'(((atan2(q,i)*3+{PI}) % (2*{PI}))+2*{PI}) % (2*{PI})-{PI}')} AS wrapped FROM e"))
def m18_wrap_phase(spark, d):
    return inputs.sweep_e(spark, d).select("sample", "tone", rnd(iq.wrap_phase(iq.angle(F.col("i"), F.col("q")) * 3)).alias("wrapped"))


@register(_with(f"e | {RESP_E}", "SELECT sweep_id, tone, point, (((round_even((4e9-f-1024e6)/1024e6*4096, 0) % 2) + 2) % 2) = 1 AS odd FROM resp"))
def p14_odd_bins(spark, d):
    return _response(inputs.sweep_e(spark, d)).select("sweep_id", "tone", "point", iq.odd_bin(F.col("f")).alias("odd"))


@register(_with("e", "SELECT sweep_id, max(point)/9.0 AS progress, count(DISTINCT point) AS n_points FROM e GROUP BY sweep_id"))
def a10_completeness(spark, d):
    return sweeps.completeness(inputs.sweep_e(spark, d), 10)


@register(_with("l", "SELECT 'L' AS sweep_id, t.tone, k.point::INT AS point FROM (SELECT DISTINCT tone FROM l) t, range(8) k(point) WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.tone = t.tone AND l.point = k.point)"))
def a10_missing_points(spark, d):
    x = inputs.sweep_l(spark, d)
    plan = x.select("sweep_id", "tone").distinct().withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return sweeps.missing_points(x, plan)


@register(_with("e", f"SELECT tone, {r('max(abs(i))/sqrt(avg(i*i))')} AS crest_i, {r('max(abs(q))/sqrt(avg(q*q))')} AS crest_q, {r('20*log10(max(abs(i))/sqrt(avg(i*i)))')} AS crest_i_db, {r('20*log10(max(abs(q))/sqrt(avg(q*q)))')} AS crest_q_db FROM e GROUP BY tone"))
def a11_crest_factors(spark, d):
    return _rounded(sweeps.crest_factors(inputs.sweep_e(spark, d), "tone"), crest_i=6, crest_q=6, crest_i_db=6, crest_q_db=6)


@register(_with("fr", "SELECT stream_id, seq, packet_counter, t::INT AS tone, i[t+1] AS i, q[t+1] AS q FROM fr, range(32) r(t)"))
def p1_samples(spark, d):
    return frames.to_samples(inputs.frames_e(spark, d))


@register(_with("fr", "SELECT stream_id, seq, packet_counter, " + ", ".join(f"{c}[{t + 1}] AS {c}_{t:04d}" for t in range(32) for c in "iq") + " FROM fr"))
def p2_wide(spark, d):
    return frames.to_wide(frames.to_samples(inputs.frames_e(spark, d)), list(range(32)))


@register(_with("fr", "SELECT stream_id, seq, packet_counter, i[8] AS i, q[8] AS q FROM fr"))
def p4_tone_series(spark, d):
    return frames.tone_series(inputs.frames_e(spark, d), 7)


@register(_with("fr", "SELECT stream_id, seq, packet_counter, i[8] AS i, q[8] AS q FROM fr WHERE seq BETWEEN 50 AND 349"))
def p4_o3_tone_series(spark, d):
    """O3: a client takes 300 samples from one on."""
    return frames.tone_series(frames.take_samples(inputs.frames_e(spark, d), 50, 300), 7)


@register(_with("fr", "SELECT stream_id, seq, seq/500.0 AS t_index, (packet_counter - min(packet_counter) OVER ())/500.0 AS t FROM fr"))
def p8_p9_time_axes(spark, d):
    out = frames.index_time(inputs.frames_e(spark, d), 500.0).withColumnRenamed("t", "t_index")
    return frames.counter_time(out, 500.0).select("stream_id", "seq", "t_index", "t")


@register(_with("fr", "SELECT stream_id, seq, (label=0)::INT AS server_request, (label=1)::INT AS set_freqs, (label=2)::INT AS set_amps, (label=3)::INT AS set_phases, (label=4)::INT AS cal_freeze FROM fr"))
def p10_named_flags(spark, d):
    from ..schemas import FLAG_NAMES

    return frames.named_flags(inputs.frames_e(spark, d)).select("stream_id", "seq", *FLAG_NAMES)


_STEPS = "SELECT stream_id, seq, packet_counter - lag(packet_counter) OVER (PARTITION BY stream_id ORDER BY seq) AS step FROM {}"


@register(_with("fr", _STEPS.format("fr")))
def w1_counter_steps_bucketed(spark, d):
    return frames.counter_steps(inputs.frames_e(spark, d), 64).select("stream_id", "seq", "step")


@register(_with("v", _STEPS.format("v")))
def w1_counter_steps(spark, d):
    return frames.counter_steps(inputs.packets_v(spark, d)).select("stream_id", "seq", "step")


@register(_with("fr", "SELECT stream_id, count(*) AS n_frames, coalesce(bool_and(step=1), true) AS contiguous, coalesce(sum(step-1), 0)::BIGINT AS n_missing FROM (" + _STEPS.format("fr") + ") GROUP BY stream_id"))
def a3_continuity(spark, d):
    return frames.continuity(inputs.frames_e(spark, d), 64).drop("n_restarts")


#: Counters of frames E as a board may give them: of each 500 frames, 400 pass 2**32 twice in steps of 15 million (once
#: right after their first), then the board restarts near 0.
_RESTARTED = "CAST((CASE WHEN seq % 500 < 400 THEN 4294964296 + (seq % 500) * 15000000 ELSE 17 + (seq % 500) * 3 END) % 4294967296 AS BIGINT)"
_EPOCHS = """SELECT *, c + 4294967296 * sum(wrap) OVER (PARTITION BY epoch ORDER BY seq) AS counter64 FROM (
  SELECT *, sum(again) OVER (ORDER BY seq)::BIGINT AS epoch, CASE WHEN again = 0 AND c < p THEN 1 ELSE 0 END AS wrap FROM (
    SELECT *, CASE WHEN (c - p + 4294967296) % 4294967296 > 16777216 THEN 1 ELSE 0 END AS again FROM (
      SELECT stream_id, seq, c, lag(c) OVER (ORDER BY seq) AS p FROM (SELECT *, """ + _RESTARTED + """ AS c FROM fr))))"""


def _restarted(spark, d):
    from pyspark.sql import functions as F

    return inputs.frames_e(spark, d).select("stream_id", "seq", F.expr(_RESTARTED).alias("packet_counter"))


@register(_with("fr", f"SELECT stream_id, seq, epoch, counter64::BIGINT AS counter64, (counter64 - first_value(counter64) OVER (PARTITION BY epoch ORDER BY seq))::BIGINT AS rebased FROM ({_EPOCHS})"))
def w2_counter_epochs(spark, d):
    """T21: wraps and restarts of the counter, in ranges of 64 frames."""
    from ..operators import epochs

    return epochs.with_epochs(_restarted(spark, d), bucket=64).drop("packet_counter")


@register(_with("fr", f"SELECT stream_id, seq, {r('t')} AS t FROM (SELECT stream_id, seq, (counter64 - first_value(counter64) OVER (PARTITION BY epoch ORDER BY seq)) / 500.0 AS t FROM ({_EPOCHS}))"))
def p9_time_over_wraps(spark, d):
    return _rounded(frames.counter_time(_restarted(spark, d), 500.0), t=6).select("stream_id", "seq", "t")


@register(_with("fr", f"SELECT stream_id, epoch, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_frames, (max(counter64) - min(counter64))::BIGINT AS n_steps FROM ({_EPOCHS}) GROUP BY stream_id, epoch"))
def a3_epoch_ranges(spark, d):
    from ..operators import epochs

    return epochs.epoch_ranges(epochs.with_epochs(_restarted(spark, d), bucket=256))


@register(_with("v", "SELECT stream_id, seq, packet_counter - first_value(packet_counter) OVER (PARTITION BY stream_id ORDER BY seq) AS rebased FROM v"))
def w2_rebased_counter(spark, d):
    return frames.rebased_counter(inputs.packets_v(spark, d)).select("stream_id", "seq", "rebased")


@register(_with("v", "SELECT stream_id, sum(packet_error)::BIGINT AS n_errors FROM v GROUP BY stream_id"))
def a4_error_count(spark, d):
    return frames.error_count(inputs.packets_v(spark, d))


@register(_with("v", "SELECT stream_id, seq, sum(packet_error) OVER (PARTITION BY stream_id ORDER BY seq)::BIGINT AS n_errors FROM v"))
def w10_running_errors(spark, d):
    return frames.running_errors(inputs.packets_v(spark, d)).select("stream_id", "seq", "n_errors")


@register(_with("v", f"SELECT stream_id, n, {r('el')} AS elapsed_s, {r('n/nullif(el,0)')} AS rate_hz FROM (SELECT stream_id, count(*) AS n, (epoch_us(max(ts))-epoch_us(min(ts)))/1e6 AS el FROM v GROUP BY stream_id)"))
def a5_receive_rate(spark, d):
    return _rounded(frames.receive_rate(inputs.packets_v(spark, d)), elapsed_s=6, rate_hz=6)


_RUNS = "SELECT stream_id, flag, any_value(value) AS value, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_frames FROM (SELECT *, sum(c) OVER (PARTITION BY stream_id, flag ORDER BY seq) AS run FROM (SELECT *, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER (PARTITION BY stream_id, flag ORDER BY seq) THEN 0 ELSE 1 END AS c FROM ({}))) GROUP BY stream_id, flag, run"


@register(_with("v", _RUNS.format("SELECT stream_id, seq, 0 AS flag, flag0 AS value FROM v")))
def w11_flag_intervals(spark, d):
    return frames.flag_intervals(inputs.packets_v(spark, d), bucket=1000)


@register(_with("fr", _RUNS.format("SELECT stream_id, seq, k::INT AS flag, (label = k)::INT AS value FROM fr, range(8) g(k)")))
def w11_flag_intervals_frames(spark, d):
    return frames.flag_intervals(inputs.frames_e(spark, d), bucket=64)


@register(_with("v | h AS (SELECT c_custkey AS stream_id, 256 * (1 + c_nationkey)::BIGINT AS acc_len, 2048e6/4096/(256 * (1 + c_nationkey)) AS sample_rate FROM customer)", f"SELECT v.stream_id, seq, acc_len, {r('sample_rate')} AS sample_rate, {r('(packet_counter - min(packet_counter) OVER (PARTITION BY v.stream_id))/sample_rate')} AS t FROM v LEFT JOIN h USING (stream_id)"))
def j6_frames_with_header(spark, d):
    """Every stream's own rate, from its header, on its frames."""
    acc = (F.lit(256) * (F.col("c_nationkey") + 1)).cast("long")
    headers = inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("stream_id"), acc.alias("acc_len"), frequency.sample_rate(acc).alias("sample_rate"))
    out = frames.with_header(frames.rebased_counter(inputs.packets_v(spark, d)), headers)
    return out.select("stream_id", "seq", "acc_len", rnd("sample_rate").alias("sample_rate"), rnd(F.col("rebased") / F.col("sample_rate")).alias("t"))


@register(_with(f"l | {RESP_L} | h AS (SELECT 'L' AS sweep_id, 1000 + count(*) AS acc_len FROM region)", f"SELECT sweep_id, tone, point, {r('i/acc_len', 9)} AS i, {r('q/acc_len', 9)} AS q FROM resp JOIN h USING (sweep_id)"))
def j6_sweep_with_header(spark, d):
    headers = inputs.table(spark, d, "region").agg((F.count("*") + 1000).alias("acc_len")).withColumn("sweep_id", F.lit("L"))
    out = frames.with_header(_response(inputs.sweep_l(spark, d)), headers, "sweep_id")
    return out.select("sweep_id", "tone", "point", rnd(F.col("i") / F.col("acc_len"), 9).alias("i"), rnd(F.col("q") / F.col("acc_len"), 9).alias("q"))


@register(_with("fr", "SELECT count(*) AS n, (count(*) FILTER (WHERE seq % 7 = 0 OR (seq % 5 = 0 AND packet_error <> 1)))::BIGINT AS n_different, count(*) FILTER (WHERE seq % 7 = 0 OR (seq % 5 = 0 AND packet_error <> 1)) = 0 AS equal FROM fr"))
def j7_differences(spark, d):
    """Every seventh frame is lost on one side, and every fifth has its error set."""
    x = inputs.frames_e(spark, d)
    y = x.where("seq % 7 != 0").withColumn("packet_error", F.when(F.col("seq") % 5 == 0, 1).otherwise(F.col("packet_error")))
    return frames.differences(x, y, ["stream_id", "seq"], ["packet_counter", "packet_error", "flags", "i", "q"])


@register(_with("fr", "SELECT count(*) AS n, 0::BIGINT AS n_different, true AS equal FROM fr"))
def s1_s4_j7_codec_round_trip(spark, d):
    """Encode to packed records, decode, and compare by frame."""
    x = inputs.frames_e(spark, d)
    back = records.decode(records.encode(x), 32)
    return frames.differences(x, back, ["stream_id", "seq"], ["packet_counter", "packet_error", "flags", "i", "q"])


@register(_with("fr", "SELECT stream_id, seq, i[1:5] AS i, q[1:5] AS q FROM fr"))
def s3_p3_truncated_decode(spark, d):
    out = records.decode(records.encode(inputs.frames_e(spark, d)), 32, keep=5).select("stream_id", "seq", "i", "q")
    return out


CHAIN = dict(psb_fftshift=0b1011, psb_scale=0.9, mixer_scale_is_1p0=True, mixer_qmc_gain=0.8, vop_current=18000.0)
_DUC = f"(amplitude/16*0.9*0.8/{powers.MIXER_SCALE})"
_POWER = f"(10*log10({_DUC}*{_DUC}*pow(18000.0/20000.0,2)))"


@register(_with("p", f"SELECT tone, {r(_DUC)} AS duc_fs, {r(_POWER)} AS vop_dbfs, {r(_POWER + '-6-1.5')} AS combiner_dbm, {r(_POWER + '-6-1.5+2-10-7+1-20')} AS power_dbm FROM p"))
def m1_tone_power(spark, d):
    c = powers.TxChain(**CHAIN, combiner_loss_db=1.5, attenuator_db=10, if_s21_db=2, mixer_loss_db=-7, rf_s21_db=1, cryostat_s21_db=-20)
    s = powers.tone_power_stages(F.col("amplitude"), c)
    return inputs.tones_p(spark, d).select("tone", *[rnd(s[k]).alias(k) for k in ("duc_fs", "vop_dbfs", "combiner_dbm")], rnd(s["cryostat_dbm"]).alias("power_dbm"))


_DAC = _POWER + "-6"
_DETAILS = {
    "amps": "amplitude", "psb_shift_units": "amplitude/16", "psb_scale_units": "amplitude/16*0.9", "dac_units": "amplitude/16*0.9*65536", "dac_fs": "amplitude/16*0.9", "duc_fs": _DUC, "duc_fs_power": f"{_DUC}*{_DUC}",
    "vop_fs": f"{_DUC}*{_DUC}*pow(18000.0/20000.0,2)", "vop_dbfs": _POWER, "dac_dbm": _DAC, "combiner_dbm": _DAC + "-1.5", "tx_if_dbm": _DAC + "-1.5+2-10", "tx_mixer_dbm": _DAC + "-1.5+2-10-7", "tx_rf_dbm": _DAC + "-1.5+2-10-7+1", "cryostat_dbm": _DAC + "-1.5+2-10-7+1-20",
}


@register(_with("p", "SELECT tone, " + ", ".join(f"{r(v, 9)} AS {k}" for k, v in _DETAILS.items()) + " FROM p"))
def m5_stage_details(spark, d):
    """Every stage of the sending chain, for every tone."""
    c = powers.TxChain(**CHAIN, combiner_loss_db=1.5, attenuator_db=10, if_s21_db=2, mixer_loss_db=-7, rf_s21_db=1, cryostat_s21_db=-20)
    out = inputs.tones_p(spark, d).select("tone", powers.tone_power_details(F.col("amplitude"), c).alias("x"))
    return out.select("tone", *[rnd(F.col("x")[k], 9).alias(k) for k in _DETAILS])


@register(_with("p", f"SELECT tone, {r(f'sqrt(pow(10, (amplitude*40 - 100 + 6 + 1.5 + 10 + 20)/10))/(18000.0/20000.0)*16/(0.9*0.8)*{powers.MIXER_SCALE}', 9)} AS amplitude FROM p"))
def m2_tone_amplitude(spark, d):
    """The amplitude that gives a power asked for."""
    c = powers.TxChain(**CHAIN, combiner_loss_db=1.5, attenuator_db=10, cryostat_s21_db=-20)
    return inputs.tones_p(spark, d).select("tone", rnd(powers.tone_amplitude(F.col("amplitude") * 40 - 100, c), 9).alias("amplitude"))


_RMS = "(pow(10, (amplitude*40-60+1.0)/20)*sqrt(2)*0.9/sqrt(2)*32768*pow(2,13-3)*0.5*1000)"


@register(_with("p", f"SELECT tone, {r(_RMS + '*cos(0.3)', 3)} AS i, {r(_RMS + '*sin(0.3)', 3)} AS q, {r('amplitude*40-60')} AS power_dbm FROM p"))
def m3_m4_accumulated_level(spark, d):
    c = powers.RxChain(adc_dbm_to_dbfs=-1.0, mixer_qmc_gain=0.9, mixer_scale_is_1p0=False, pfb_fftshift=0b111, rx_mix_scale=0.5, acc_len=1000)
    i, q = powers.accumulated_level(F.col("amplitude") * 40 - 60, c, 0.3)
    return inputs.tones_p(spark, d).select("tone", rnd(i, 3).alias("i"), rnd(q, 3).alias("q"), rnd(powers.adc_input_power(i, q, c)).alias("power_dbm"))


@register(_with("p", "SELECT tone, acc_len, round(2048e6/4096/acc_len, 6) AS rate FROM (SELECT tone, greatest(least(4*ceil(round_even(2048e6/4096/((tone+1)*7.3), 0)/4), 65535), 1)::BIGINT AS acc_len FROM p)"))
def m7_m8_sample_rate(spark, d):
    out = inputs.tones_p(spark, d).select("tone", frequency.accumulation_length((F.col("tone") + 1) * 7.3).alias("acc_len"))
    return out.withColumn("rate", F.round(frequency.sample_rate(F.col("acc_len")), 6))


_BB = "(freq_hz - 1e9 - 512e6)"


@register(_with("p", f"SELECT tone, {r(_BB, 3)} AS bb_tx, {r('4096e6 - (5e9 - freq_hz) + 3072e6', 3)} AS bb_zone2, {r('freq_hz', 3)} AS back, {r('freq_hz', 3)} AS back2 FROM p"))
def m9_m10_frequencies(spark, d):
    f = F.col("freq_hz")
    one = frequency.rf_to_baseband(f, 512e6, 1, 1e9, 1)
    two = frequency.rf_to_baseband(f, 3072e6, 2, 5e9, -1, receive=True)
    back, back2 = frequency.baseband_to_rf(one, 512e6, 1, 1e9, 1), frequency.baseband_to_rf(two, 3072e6, 2, 5e9, -1, receive=True)
    return inputs.tones_p(spark, d).select("tone", rnd(one, 3).alias("bb_tx"), rnd(two, 3).alias("bb_zone2"), rnd(back, 3).alias("back"), rnd(back2, 3).alias("back2"))


_BIN = "(((round_even(greatest(least({0}/2048e6*{1}, {1}/2.0-1), -{1}/2.0), 0)::BIGINT % {1}) + {1}) % {1})"
_OFF = "(({0}) - (CASE WHEN b < {1}/2 THEN b ELSE b - {1} END) * (2048e6/{1}))"


@register(_with(f"p | b AS (SELECT *, {_BIN.format(_BB, 4096)} AS b, {_BIN.format(_BB, 8192)} AS rb FROM p)", f"SELECT tone, b::INT AS tx_bin, rb::INT AS rx_bin, {r(_OFF.format(_BB, 4096), 3)} AS tx_offset_hz, {r(_OFF.format(_BB, 4096) + '/500e3*2*' + PI)} AS tx_phase_inc, {r('cos(' + _OFF.format(_BB, 4096) + '/500e3*2*' + PI + ')')} AS tx_step_re, ({_BB} < -1024e6 OR {_BB} > 2047*2048e6/4096 + 500e3) AS outside FROM b"))
def j3_m11_p13_bins(spark, d):
    t = inputs.tones_p(spark, d).withColumn("bb_hz", frequency.rf_to_baseband(F.col("freq_hz"), 512e6, 1, 1e9, 1))
    placed = tones.place_in_bins(t).withColumn("outside", frequency.out_of_band(F.col("bb_hz"), 4096, 500e3))
    return _rounded(placed.select("tone", "tx_bin", "rx_bin", "tx_offset_hz", "tx_phase_inc", "tx_step_re", "outside"), tx_offset_hz=3, tx_phase_inc=6, tx_step_re=6)


@register(_with(f"p | b AS (SELECT *, {_BIN.format('(freq_hz*0.1 - 100e6)', 4096)}::INT AS tx_bin FROM p)", "SELECT tone_set, tx_bin, count(*) AS n_tones, max(tone) AS winner FROM b GROUP BY tone_set, tx_bin HAVING count(*) > 1"))
def a13_bin_collisions(spark, d):
    t = inputs.tones_p(spark, d).withColumn("tx_bin", frequency.nearest_bin(F.col("freq_hz") * 0.1 - 100e6, 4096))
    return tones.bin_collisions(t, "tone_set")


_TURN = f"((((x/{PI}+1) % 2.0)+2.0) % 2.0 - 1)"


@register(_with("p | y AS (SELECT tone, amplitude, amplitude*20-7 AS x FROM p)", f"SELECT tone, trunc({_TURN}*1073741824.0)::BIGINT AS step, {r(f'trunc({_TURN}*1073741824.0)/1073741824.0*{PI}')} AS phase, least(round_even(amplitude*1.5*4096, 0)::BIGINT, 4095) AS amp, {r('least(round_even(amplitude*1.5*4096, 0), 4095)/4096')} AS amp_back FROM y"))
def m12_m13_m14_fixed_point(spark, d):
    t = inputs.tones_p(spark, d)
    step, amp = fixedpoint.phase_to_fixed(F.col("amplitude") * 20 - 7, 30), fixedpoint.amplitude_to_fixed(F.col("amplitude") * 1.5, 12)
    return t.select("tone", step.alias("step"), rnd(fixedpoint.fixed_to_phase(step, 30)).alias("phase"), amp.alias("amp"), rnd(fixedpoint.fixed_to_amplitude(amp, 12)).alias("amp_back"))


_PART = "(((least(round_even({0}*32768, 0)::BIGINT, 32767) % 65536) + 65536) % 65536)"


@register(_with("e", f"SELECT sample, tone, {_PART.format('i/4')}*65536 + {_PART.format('q/4')} AS word, {r('least(round_even(i/4*32768,0),32767)/32768')} AS re, {r('least(round_even(q/4*32768,0),32767)/32768')} AS im FROM e"))
def m15_packed_words(spark, d):
    word = fixedpoint.complex_to_word(F.col("i") / 4, F.col("q") / 4, 16)
    re, im = fixedpoint.word_to_complex(word, 16)
    return inputs.sweep_e(spark, d).select("sample", "tone", word.alias("word"), rnd(re).alias("re"), rnd(im).alias("im"))


@register(_with("p", f"SELECT tone, tone_set, {r(f'{PI}*k*k/n', 5)} AS phase FROM (SELECT *, (freq_hz-min(freq_hz) OVER w)/nullif(max(freq_hz) OVER w - min(freq_hz) OVER w, 0)*(count(*) OVER w - 1) AS k, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY tone_set))"))
def m16_newman_phases(spark, d):
    return tones.newman_phases(inputs.tones_p(spark, d)).select("tone", "tone_set", rnd("phase", 5).alias("phase"))


_UNIFORM = "(('0x' || substr(md5('0:' || {} || ':' || tone), 1, 13))::BIGINT / 4503599627370496.0)"


@register(_with("p", f"SELECT tone, tone_set, {r(_UNIFORM.format('tone_set') + '*2*' + PI)} AS phase FROM p"))
def m17_random_phases(spark, d):
    return tones.random_phases(inputs.tones_p(spark, d)).select("tone", "tone_set", rnd("phase").alias("phase"))


@register(_with("p", f"SELECT tone, {r('20*log10(abs(amplitude)) - min(20*log10(abs(amplitude))) OVER (PARTITION BY tone_set)')} AS att_db FROM p"))
def m24_attenuations(spark, d):
    return tones.attenuations(inputs.tones_p(spark, d)).select("tone", rnd("att_db").alias("att_db"))


@register(_with("p", "SELECT tone_set, min(freq_hz) AS f_min, max(freq_hz) AS f_max, count(*) AS n FROM p GROUP BY tone_set"))
def a12_extremes(spark, d):
    return tones.extremes(inputs.tones_p(spark, d))


@register(_with("p", "SELECT tone_set, tone, row_number() OVER (PARTITION BY tone_set ORDER BY freq_hz, tone)::INT AS rank FROM p"))
def w12_frequency_rank(spark, d):
    return tones.frequency_rank(inputs.tones_p(spark, d)).select("tone_set", "tone", "rank")


@register(_with("p", f"SELECT tone_set, {r('max(step)', 3)} AS max_step, bool_and(abs(step-1e6) <= 1e-8+1e-5*1e6) AS even FROM (SELECT *, lead(freq_hz) OVER (PARTITION BY tone_set ORDER BY freq_hz, tone) - freq_hz AS step FROM p) GROUP BY tone_set"))
def w9_spacing(spark, d):
    return _rounded(tones.spacing(inputs.tones_p(spark, d), 1e6), max_step=3)


_NEAR = "near AS (SELECT p.*, (SELECT arg_min(cv, (abs(cf - freq_hz), o)) FROM s) AS value_db FROM p)"


@register(_with(f"p | s | {_NEAR}", f"SELECT tone, {r('value_db')} AS value_db FROM near"))
def j1_nearest_calibration(spark, d):
    return tones.nearest_value(inputs.tones_p(spark, d), inputs.cal_s(spark, d)).select("tone", rnd("value_db").alias("value_db"))


_STAGED = f"(10*log10(pow(amplitude/16*0.9*0.8/{powers.MIXER_SCALE},2)*pow(18000.0/20000.0,2)) + value_db - 1.5 - abs(10.0) + value_db)"


def _staged(spark, d) -> DataFrame:
    t = inputs.tones_p(spark, d).withColumns({"analog_hz": F.col("freq_hz"), "rf_hz": F.col("freq_hz")})
    return tones.with_stages(t, {"dac_dbfs_to_dbm": "S", "combiner_loss_db": 1.5, "attenuator_db": 10, "rf_s21_db": "S", "cryostat_s21_db": "S"}, {"S": inputs.cal_s(spark, d)}, cryostat=False)


@register(_with(f"p | s | {_NEAR}", f"SELECT tone, {r(_STAGED)} AS power_dbm FROM near"))
def j2_m5_calibrated_power(spark, d):
    return tones.tone_powers(_staged(spark, d), CHAIN).select("tone", rnd("power_dbm").alias("power_dbm"))


@register(_with(f"p | s | {_NEAR}", f"SELECT tone, {r(f'sqrt(pow(10, (amplitude*40 - 100 - value_db + 1.5 + 10 - value_db)/10))/(18000.0/20000.0)*16/(0.9*0.8)*{powers.MIXER_SCALE}', 9)} AS amplitude FROM near"))
def m6_calibrated_amplitude(spark, d):
    powered = _staged(spark, d).withColumn("power_dbm", F.col("amplitude") * 40 - 100).drop("amplitude")
    return tones.tone_amplitudes(powered, CHAIN).select("tone", rnd("amplitude", 9).alias("amplitude"))


@register(_with("p", f"SELECT tone, k::INT AS point, {r('CASE WHEN 4-k = 4 THEN freq_hz+5e3 ELSE freq_hz-5e3+(4-k)*1e4/4 END', 3)} AS f FROM p, range(5) g(k)"))
def j4_m22_m25_o2_sweep_grid(spark, d):
    t = inputs.tones_p(spark, d).select("tone", F.col("freq_hz").alias("centre_hz"))
    return sweeps.grid(t, 5, "down", 1e4).select("tone", "point", rnd("f", 3).alias("f"))


@register(_with("p", f"SELECT tone, {r('CASE WHEN freq_hz + (tone % 5)*1e3 BETWEEN freq_hz-2e3 AND freq_hz+2e3 THEN freq_hz + (tone % 5)*1e3 ELSE freq_hz END', 3)} AS freq_hz FROM p"))
def j5_restore_frequencies(spark, d):
    t = inputs.tones_p(spark, d)
    now = t.select("tone", (F.col("freq_hz") + F.pmod("tone", F.lit(5)) * 1e3).alias("freq_hz"))
    return _rounded(sweeps.restore_frequencies(now, t.select("tone", F.col("freq_hz").alias("centre_hz"), F.lit(4e3).alias("span_hz"))), freq_hz=3)


@register(_with(f"l | m AS (SELECT DISTINCT sweep_id, tone, point, {_BIN.format('(f-1e9-tone*1e5+point*4e4)', 4096)}::INT AS b FROM l)", "SELECT sweep_id, point, bool_and(same) AS skip FROM (SELECT *, coalesce(b = lag(b) OVER (PARTITION BY sweep_id, tone ORDER BY point), false) AS same FROM m) GROUP BY sweep_id, point"))
def w8_unchanged_maps(spark, d):
    x = inputs.sweep_l(spark, d).select("sweep_id", "tone", "point", frequency.nearest_bin(F.col("f") - 1e9 - F.col("tone") * 1e5 + F.col("point") * 4e4, 4096).alias("tx_bin")).distinct()
    return tones.unchanged_maps(x)


@register("WITH c AS (SELECT o_orderpriority AS board, o_orderkey AS tone, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS tx_bin, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_custkey END AS rx_bin FROM orders) SELECT c.board, tone, tx_bin, n_tx, n_rx, n_tx = n_rx AS same_count FROM c JOIN (SELECT board, count(*) FILTER (WHERE tx_bin <> -1) AS n_tx, count(*) FILTER (WHERE rx_bin <> -1) AS n_rx FROM c GROUP BY board) USING (board) WHERE tx_bin <> -1")
def p12_o5_active_channels(spark, d):
    o = inputs.table(spark, d, "orders")
    off = lambda k: F.when(F.pmod("o_orderkey", F.lit(k)) == 0, F.lit(-1)).otherwise(F.col("o_custkey"))
    c = o.select(F.col("o_orderpriority").alias("board"), F.col("o_orderkey").alias("tone"), off(3).alias("tx_bin"), off(4).alias("rx_bin"))
    return tones.active_channels(c).select("board", "tone", "tx_bin", "n_tx", "n_rx", "same_count")


_SAT = "SELECT {0}, max(i)/32768.0 AS max_i, max(q)/32768.0 AS max_q, min(i)/32768.0 AS min_i, min(q)/32768.0 AS min_q, round(count(*)/2048e6, 12) AS integration_s, (greatest(max(i), max(q))/32768.0 >= 1 OR least(min(i), min(q))/32768.0 <= -1) AS saturated FROM sn GROUP BY {0}"


@register(_with("sn", _SAT.format("run")))
def a6_adc_saturation(spark, d):
    return health.saturation(inputs.snapshot_l(spark, d), "run").withColumn("integration_s", F.round("integration_s", 12))


@register(_with("sn", "SELECT run, bool_or(saturated) AS saturated FROM (" + _SAT.format("run, dac") + ") GROUP BY run"))
def a7_dac_saturation(spark, d):
    return health.any_saturated(health.saturation(inputs.snapshot_l(spark, d), "run", "dac"), "run")


_DELTA = "SELECT o_orderpriority AS board, o_orderstatus AS block, arg_max(o_custkey, (o_orderdate, o_orderkey)) - arg_min(o_custkey, (o_orderdate, o_orderkey)) AS delta FROM orders GROUP BY board, block"


@register(f"SELECT board, block, delta, delta <> 0 AS overflowed FROM ({_DELTA})")
def a8_overflow(spark, d):
    return health.overflow(inputs.counters_o(spark, d))


@register(f"SELECT board, coalesce(bool_or(delta <> 0 AND block IN ('O','F')), false) AS tx_overflow, coalesce(bool_or(delta <> 0 AND block = 'P'), false) AS rx_overflow, bool_or(delta <> 0) AS any_overflow FROM ({_DELTA}) GROUP BY board")
def a8_overflow_sides(spark, d):
    return health.overflow_sides(health.overflow(inputs.counters_o(spark, d)), ("O", "F"), ("P",))


@register("SELECT p_partkey AS tone, (CASE WHEN p_size % 2 = 0 THEN 1024e6 ELSE -3072e6 END) AS up_hz, (CASE WHEN p_size % 2 = 0 THEN -1024e6 ELSE 3072e6 END) AS down_hz FROM part")
def m27_mixer_frequencies(spark, d):
    up, down = frequency.mixer_frequency(F.when(F.pmod("p_size", F.lit(2)) == 0, 1).otherwise(2))
    return inputs.table(spark, d, "part").select(F.col("p_partkey").alias("tone"), up.alias("up_hz"), down.alias("down_hz"))


@register(_with(f"e | {RESP_E}", f"SELECT sweep_id, tone, point, {r('f', 3)} AS f, {r('i')} AS i, {r('q')} AS q, {r('ei')} AS ei, {r('eq')} AS eq FROM resp"))
def s9_sweep_payload_round_trip(spark, d):
    return _rounded(text.decode_sweeps(text.encode_sweeps(_response(inputs.sweep_e(spark, d)))), f=3, i=6, q=6, ei=6, eq=6)


@register(_with(f"e | {RESP_E}", "SELECT sweep_id, point, string_agg(printf('%.6f %.6f %.6f %.6f %.6f', f, round(i,9), round(q,9), round(ei,9), round(eq,9)), ' ' ORDER BY tone) AS value FROM resp GROUP BY sweep_id, point"))
def s11_sweep_text(spark, d):
    resp = _response(inputs.sweep_e(spark, d))
    return text.sweep_text(resp.withColumns({c: F.round(c, 9) for c in ("i", "q", "ei", "eq")}))


@register(_with("p", "SELECT tone, printf('K%03d', tone) || chr(9) || printf('%.6f', freq_hz) || chr(9) || printf('%.6f', 0.0) || chr(9) || '1' || chr(9) || '0' AS value FROM p"))
def s14_tone_list_lines(spark, d):
    return text.tone_list_lines(inputs.tones_p(spark, d))


@register(_with("p", f"SELECT tone_set, k::BIGINT AS sample, {r(f'sum(amplitude*cos(2*{PI}*((k*(freq_hz/4096e6)) % 1.0) + tone))')} AS i, {r(f'sum(amplitude*sin(2*{PI}*((k*(freq_hz/4096e6)) % 1.0) + tone))')} AS q FROM p, range(512) g(k) GROUP BY tone_set, k"))
def m26_waveform(spark, d):
    """512 samples of every tone set's waveform."""
    t = inputs.tones_p(spark, d).withColumn("phase", F.col("tone").cast("double"))
    return _rounded(sweeps.waveform(t, 512, 4096e6), i=6, q=6)


_BAND = "b AS (SELECT p_brand AS sweep_id, 3e9 AS c, 2048e6 AS bw, count(*) AS n, 2048e6/count(*)/200 AS step FROM part GROUP BY p_brand), pt AS (SELECT *, floor(bw/step/n) AS points, bw/n AS sp FROM b), t AS (SELECT *, sp*(points-1)/points AS span, unnest(range(n)) AS tone FROM pt)"


@register(f"WITH {_BAND} SELECT sweep_id, tone::INT AS tone, points::BIGINT AS points, {r('span', 3)} AS span_hz, {r('c - bw/2 + tone*sp + (' + _UNIFORM.format('sweep_id') + ' - 0.5)*(span/points) + floor(points/2)*sp/points', 3)} AS centre_hz FROM t")
def m23_wideband_plan(spark, d):
    """A band for each brand, with a tone for each of its parts."""
    n = F.count("*")
    bands = inputs.table(spark, d, "part").groupBy(F.col("p_brand").alias("sweep_id")).agg(F.lit(3e9).alias("centre_hz"), F.lit(2048e6).alias("bandwidth_hz"), n.alias("n_tones"), (F.lit(2048e6) / n / 200).alias("step_hz"))
    return _rounded(sweeps.wideband_plan(bands), span_hz=3, centre_hz=3)


@register(f"WITH {_BAND} SELECT sweep_id, tone::INT AS tone, points::BIGINT AS points, {r('span', 3)} AS span_hz, {r('least(greatest(c - bw/2 + tone*sp + (' + _UNIFORM.format('sweep_id') + ' - 0.5)*(span/points) + floor(points/2)*sp/points, 2.5e9), 3.4e9)', 3)} AS centre_hz FROM t")
def m23_clipped_plan(spark, d):
    """Centres are held within 2.5 and 3.4 GHz."""
    n = F.count("*")
    bands = inputs.table(spark, d, "part").groupBy(F.col("p_brand").alias("sweep_id")).agg(F.lit(3e9).alias("centre_hz"), F.lit(2048e6).alias("bandwidth_hz"), n.alias("n_tones"), (F.lit(2048e6) / n / 200).alias("step_hz"))
    return _rounded(sweeps.wideband_plan(bands, (2.5e9, 3.4e9)), span_hz=3, centre_hz=3)
