"""Ordered per-stream signals."""

from pyspark.sql import functions as F

from streamlens.functions import vec
from streamlens.operators import signals
from streamlens.plans.registry import EV, FR, TR, dot, lng, query, r
from streamlens.plans.scalar import rd
from streamlens.sources import tables

W = "OVER (PARTITION BY stream_id ORDER BY frame_idx)"
THUMB = "list_transform(e, lambda x: abs(x) * 255)"


def thumb_frames(spark, path):
    fr = tables.frames(spark, path)
    return fr.transform(lambda d: d.withColumn("thumb", F.transform(vec.as_double(F.col("embedding")), lambda x: F.abs(x) * 255)))


@query("c1_motion", f"""WITH {FR}, p AS (SELECT stream_id, frame_idx, e, lag(e) {W} AS q FROM fr)
SELECT stream_id, frame_idx, {r("CASE WHEN q IS NULL THEN 0.0 ELSE list_sum(list_transform(range(1, 65), lambda i: abs(abs(e[i]) * 255 - abs(q[i]) * 255))) / 64 / 255.0 END", "motion")} FROM p""")
def c1(spark, path):
    return signals.motion(thumb_frames(spark, path)).df.select("stream_id", "frame_idx", rd(F.col("motion"), "motion"))


@query("c2_scene_change", f"""WITH {FR}, p AS (SELECT stream_id, frame_idx, e, lag(e) {W} AS q FROM fr)
SELECT stream_id, frame_idx, {r(f"CASE WHEN q IS NULL THEN 0.0 ELSE 1 - {dot('e', 'q')} END", "scene_change")} FROM p""")
def c2(spark, path):
    return signals.scene_change(tables.frames(spark, path)).df.select("stream_id", "frame_idx", rd(F.col("scene_change"), "scene_change"))


MIX = "list_transform(range(1, 65), lambda i: (1 - w) * ref[i] + w * e[i])"
NOVELTY = f"""RECURSIVE {FR}, k AS (SELECT stream_id, frame_idx, t, e, CAST(frame_idx AS BIGINT) AS f FROM fr),
s AS (
  SELECT stream_id, f, t, e AS ref, 0.0::DOUBLE AS novelty FROM k WHERE f = 0
  UNION ALL
  SELECT stream_id, f, t, list_transform(m, lambda x: x / sqrt({dot('m', 'm')})), novelty FROM (
    SELECT stream_id, f, t, {MIX} AS m, novelty FROM (
      SELECT k.stream_id, k.f, k.t, k.e, s.ref, 1 - pow(0.5, (k.t - s.t) / 2.0) AS w,
        CASE WHEN k.f < 5 THEN 0.0 ELSE 1 - {dot('s.ref', 'k.e')} END AS novelty
      FROM s JOIN k ON k.stream_id = s.stream_id AND k.f = s.f + 1) a) b)"""


@query("c3_reference_novelty", f"WITH {NOVELTY} SELECT stream_id, f AS frame_idx, {r('novelty', 'novelty')} FROM s")
def c3(spark, path):
    return signals.reference_novelty(tables.frames(spark, path), half_life=2.0).withColumn("novelty", F.round("novelty", 6))


def cell_frames(spark, path):
    return tables.frames(spark, path).transform(lambda d: d.withColumn("cells", tables.cells(F.col("embedding"), 8)))


LEN = "sqrt(list_sum(list_transform(v, lambda y: y * y)))"
#: One reference of unit length for each of the eight cells of a frame; ``d``: distances before the frame enters them.
PATCH = f"""kc AS (SELECT k.*, list_transform(list_transform(range(0, 8), lambda c: e[c * 8 + 1:c * 8 + 8]), lambda v: list_transform(v, lambda x: CASE WHEN {LEN} > 0 THEN x / {LEN} ELSE x END)) AS cells FROM k),
pt AS (
  SELECT stream_id, f, t, cells AS ref, list_transform(range(0, 8), lambda c: 0.0::DOUBLE) AS d FROM kc WHERE f = 0
  UNION ALL
  SELECT stream_id, f, t, list_transform(m, lambda v: list_transform(v, lambda x: CASE WHEN {LEN} > 0 THEN x / {LEN} ELSE x END)), d FROM (
    SELECT stream_id, f, t, d, list_transform(range(1, 9), lambda c: list_transform(range(1, 9), lambda i: (1 - w) * ref[c][i] + w * cells[c][i])) AS m FROM (
      SELECT kc.stream_id, kc.f, kc.t, kc.cells, pt.ref, 1 - pow(0.5, (kc.t - pt.t) / 2.0) AS w,
        list_transform(range(1, 9), lambda c: 1 - list_sum(list_transform(range(1, 9), lambda i: pt.ref[c][i] * kc.cells[c][i]))) AS d
      FROM pt JOIN kc ON kc.stream_id = pt.stream_id AND kc.f = pt.f + 1) a) b)"""
TOP3 = "CASE WHEN pt.f < 5 THEN 0.0 ELSE greatest(0.0, least(2.0, list_avg(list_reverse_sort(pt.d)[1:3]))) END"


@query("c4_patch_novelty", f"WITH {NOVELTY}, {PATCH} SELECT stream_id, f AS frame_idx, {r(TOP3, 'novelty')} FROM pt")
def c4(spark, path):
    d = signals.reference_novelty(cell_frames(spark, path), column="cells", cells=True, top_k=3)
    return d.withColumn("novelty", F.round("novelty", 6))


@query("c5_cell_distance", f"WITH {NOVELTY}, {PATCH} SELECT stream_id, f AS frame_idx, CAST(i - 1 AS INTEGER) AS cell, {r('d[i]', 'distance')} FROM pt, unnest(range(1, 9)) x(i)")
def c5(spark, path):
    d = signals.reference_novelty(cell_frames(spark, path), column="cells", cells=True, emit_cells=True)
    return d.select("stream_id", "frame_idx", F.posexplode("cell_distance").alias("cell", "distance")).withColumn("distance", F.round("distance", 6))


@query("c6_combined_signals", f"""WITH {NOVELTY}, p AS (SELECT stream_id, frame_idx, e, lag(e) {W} AS q FROM fr)
SELECT s.stream_id, p.frame_idx, {r("CASE WHEN q IS NULL THEN 0.0 ELSE list_sum(list_transform(range(1, 65), lambda i: abs(abs(e[i]) * 255 - abs(q[i]) * 255))) / 64 / 255.0 END", "motion")},
{r(f"CASE WHEN q IS NULL THEN 0.0 ELSE 1 - {dot('e', 'q')} END", "scene_change")}, {r('novelty', 'novelty')}
FROM s JOIN p ON s.stream_id = p.stream_id AND s.f = p.frame_idx""")
def c6(spark, path):
    d = signals.combined_signals(thumb_frames(spark, path))
    return d.select("stream_id", "frame_idx", *[rd(F.col(c), c) for c in ("motion", "scene_change", "novelty")])


@query("c6_combined_with_patches", f"""WITH {NOVELTY}, {PATCH}, p AS (SELECT stream_id, frame_idx, e, lag(e) {W} AS q FROM fr)
SELECT s.stream_id, p.frame_idx, {r("CASE WHEN q IS NULL THEN 0.0 ELSE list_sum(list_transform(range(1, 65), lambda i: abs(abs(e[i]) * 255 - abs(q[i]) * 255))) / 64 / 255.0 END", "motion")},
{r(f"CASE WHEN q IS NULL THEN 0.0 ELSE 1 - {dot('e', 'q')} END", "scene_change")}, {r('novelty', 'novelty')}, {r(TOP3, 'novelty_patch')}
FROM s JOIN p ON s.stream_id = p.stream_id AND s.f = p.frame_idx JOIN pt ON pt.stream_id = s.stream_id AND pt.f = s.f""")
def c6_patches(spark, path):
    fr = thumb_frames(spark, path).transform(lambda d: d.withColumn("cells", tables.cells(F.col("embedding"), 8)))
    d = signals.combined_signals(fr, cells=True)
    return d.select("stream_id", "frame_idx", *[rd(F.col(c), c) for c in ("motion", "scene_change", "novelty", "novelty_patch")])


@query("c7_interval_ms", f"""WITH {TR}, x AS (SELECT stream_id, frame_idx, (t - lag(t) {W}) * 1000.0::DOUBLE AS d FROM tr) SELECT stream_id, frame_idx, {r('d', 'interval_ms', 3)} FROM x WHERE d IS NOT NULL""")
def c7(spark, path):
    laid = signals.interval_ms(tables.trace(spark, path))
    return laid.df.filter("interval_ms is not null").select("stream_id", "frame_idx", rd(F.col("interval_ms"), "interval_ms", 3))


WIN_H = 240


@query("c8_rolling_quantile", f"""WITH {TR} SELECT stream_id, frame_idx, round(CASE WHEN count(*) OVER w >= 10 THEN quantile_cont(novelty, 0.8) OVER w END, 6) AS threshold FROM tr
WINDOW w AS (PARTITION BY stream_id ORDER BY t_us RANGE BETWEEN {WIN_H * 3_600_000_000} PRECEDING AND CURRENT ROW)""")
def c8(spark, path):
    k = signals.RollingQuantile(0.8, WIN_H * 3600.0, 10)
    return signals.fold(tables.trace(spark, path), k).withColumn("threshold", F.round("threshold", 6))


MOVES = "mv AS (SELECT * FROM (SELECT *, lag(state_id) OVER (PARTITION BY stream_id ORDER BY frame_idx) AS prev_state FROM tr) WHERE prev_state <> state_id)"


@query("c9_transitions", f"WITH {TR}, {MOVES} SELECT stream_id, frame_idx, prev_state, state_id FROM mv")
def c9(spark, path):
    return signals.transitions(tables.trace(spark, path)).df.select("stream_id", "frame_idx", "prev_state", "state_id")


@query("c10_event_quiet_masks", f"""WITH {TR}, {MOVES}, j AS (SELECT tr.stream_id, tr.frame_idx, max(CASE WHEN tr.frame_idx >= mv.frame_idx AND tr.frame_idx < mv.frame_idx + 2 THEN 1 ELSE 0 END) AS ev,
 max(CASE WHEN tr.frame_idx >= mv.frame_idx - 1 AND tr.frame_idx < mv.frame_idx + 3 THEN 1 ELSE 0 END) AS near FROM tr LEFT JOIN mv ON tr.stream_id = mv.stream_id GROUP BY ALL)
SELECT stream_id, frame_idx, ev = 1 AS is_event, near = 0 AND frame_idx >= 15 AS is_quiet FROM j""")
def c10(spark, path):
    return signals.event_masks(tables.trace(spark, path), 2, 1, 15).df.select("stream_id", "frame_idx", "is_event", "is_quiet")


# A row "fires" here when its novelty reaches 0.2: a rule both engines can state without a fold.
FIRED = "f AS (SELECT *, novelty >= 0.2 AS fired FROM tr)"
HELD = f"""h AS (SELECT *, last_value(CASE WHEN fired THEN frame_idx END IGNORE NULLS) {W} AS hf, last_value(CASE WHEN fired THEN state_id END IGNORE NULLS) {W} AS hs,
 last_value(CASE WHEN fired THEN answer END IGNORE NULLS) {W} AS ha FROM f)"""


def fired_trace(spark, path):
    return tables.trace(spark, path).transform(lambda d: d.withColumn("fired", F.col("novelty") >= 0.2))


@query("c11_held_answer", f"WITH {TR}, {FIRED}, {HELD} SELECT stream_id, frame_idx, hf AS held_frame_idx, hs AS held_state_id, ha AS held_answer FROM h")
def c11(spark, path):
    laid = signals.held_answer(fired_trace(spark, path), F.col("fired"), ["frame_idx", "state_id", "answer"])
    return laid.df.select("stream_id", "frame_idx", "held_frame_idx", "held_state_id", "held_answer")


@query("c12_staleness", f"WITH {TR}, {FIRED}, {HELD} SELECT stream_id, frame_idx, {r('(frame_idx - hf) / 30.0::DOUBLE * 1000.0', 'staleness_ms')} FROM h")
def c12(spark, path):
    laid = signals.held_answer(fired_trace(spark, path), F.col("fired"), ["frame_idx"])
    return laid.df.select("stream_id", "frame_idx", rd(signals.staleness_ms(F.col("frame_idx"), F.col("held_frame_idx"), 30.0), "staleness_ms"))


@query("c13_call_labels", f"""WITH {TR}, {FIRED}, c AS (SELECT stream_id, frame_idx, state_id, lag(state_id) {W} AS p FROM f WHERE fired)
SELECT stream_id, frame_idx, state_id, p AS prev_call_state, state_id <> p AS justified FROM c""")
def c13(spark, path):
    tr = fired_trace(spark, path)
    calls = signals.call_labels(tr.with_df(tr.df.filter("fired")))
    return calls.df.select("stream_id", "frame_idx", "state_id", "prev_call_state", "justified")


@query("c14_scene_states", f"""WITH {TR}, c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS ch FROM (SELECT tr.*, split_part(answer, ' ', 3) AS event_type FROM tr) WINDOW w AS (PARTITION BY stream_id ORDER BY frame_idx)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY stream_id ORDER BY frame_idx) AS island FROM c)
SELECT stream_id, {lng('island', 'island')}, any_value(event_type) AS answer, {r('min(t)', 'since_t', 3)}, min(frame_idx) AS evidence_frame, count(*) AS confirmations, {r('max(t) - min(t)', 'held_for_s', 3)} FROM i GROUP BY stream_id, island""")
def c14(spark, path):
    tr = tables.trace(spark, path).transform(lambda d: d.withColumn("answer", F.split("answer", " ")[2]))
    return signals.scene_states(tr).select("stream_id", F.col("island").cast("long").alias("island"), "answer", rd(F.col("since_t"), "since_t", 3),
                                           "evidence_frame", "confirmations", rd(F.col("held_for_s"), "held_for_s", 3))


# Queue depth series: depth = whole tenths of the value, time in days so that a window has rows.
DEPTH = "dp AS (SELECT stream_id, event_id, t / 86400.0 AS d, CAST(floor(value / 10) AS INTEGER) AS depth, row_number() OVER (PARTITION BY stream_id ORDER BY t_us, event_id) AS rn FROM ev)"


def depth_laid(spark, path):
    ev = tables.events_laid(spark, path)
    return ev.transform(lambda d: d.withColumns({"d": F.col("t") / 86400.0, "depth": F.floor(F.col("value") / 10).cast("int")}))


@query("c15_rolling_mean", f"""WITH {EV}, {DEPTH}, g AS (SELECT stream_id, median(x) AS m FROM (SELECT stream_id, d - lag(d) OVER (PARTITION BY stream_id ORDER BY rn) AS x FROM dp) WHERE x IS NOT NULL GROUP BY 1),
n AS (SELECT stream_id, greatest(1, CAST(round(1 / greatest(1e-6, m)) AS BIGINT)) AS n FROM g),
s AS (SELECT dp.stream_id, event_id, rn, n, (SELECT avg(b.depth) FROM dp b WHERE b.stream_id = dp.stream_id AND b.rn > dp.rn - n AND b.rn <= dp.rn) AS smooth FROM dp JOIN n ON dp.stream_id = n.stream_id)
SELECT stream_id, event_id, n AS n_rows, {r('smooth', 'smooth')} FROM s WHERE rn >= n""")
def c15(spark, path):
    d = signals.rolling_mean(depth_laid(spark, path), "depth", "d")
    return d.select("stream_id", "event_id", "n_rows", rd(F.col("smooth"), "smooth"))


@query("c16_relative_time", f"WITH {EV} SELECT stream_id, event_id, {r('t - min(t) OVER (PARTITION BY stream_id)', 't_rel', 3)} FROM ev")
def c16(spark, path):
    laid = signals.relative_time(tables.events_laid(spark, path), "t")
    return laid.df.select("stream_id", "event_id", rd(F.col("t_rel"), "t_rel", 3))


@query("c17_peak_after", f"WITH {TR} SELECT stream_id, frame_idx, {r('max(novelty) OVER (PARTITION BY stream_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING)', 'peak_after')} FROM tr")
def c17(spark, path):
    return signals.peak_after(tables.trace(spark, path), "novelty", 60).df.select("stream_id", "frame_idx", rd(F.col("peak_after"), "peak_after"))


@query("c18_running_rate", f"""WITH {TR}, {FIRED}, x AS (SELECT stream_id, frame_idx, t, count(*) FILTER (fired) {W} AS n_calls, min(t) OVER (PARTITION BY stream_id) AS t0, novelty FROM f),
q AS (SELECT stream_id, frame_idx, CASE WHEN count(*) OVER w >= 3 THEN quantile_cont(novelty, 0.95) OVER w END AS p95 FROM tr WINDOW w AS (PARTITION BY stream_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING))
SELECT x.stream_id, x.frame_idx, x.n_calls, {r('CASE WHEN t > t0 THEN n_calls / ((t - t0) / 60.0) END', 'calls_per_min', 9)}, {r('p95', 'running_p95')} FROM x JOIN q ON x.stream_id = q.stream_id AND x.frame_idx = q.frame_idx""")
def c18(spark, path):
    tr = fired_trace(spark, path)
    rate = signals.running_rate(tr, F.col("fired"), "t").df.select("stream_id", "frame_idx", "n_calls", rd(F.col("calls_per_min"), "calls_per_min", 9))
    p95 = signals.fold(tr, signals.RunningQuantile("novelty", 0.95, 3)).select("stream_id", "frame_idx", rd(F.col("running_q"), "running_p95"))
    return rate.join(p95, ["stream_id", "frame_idx"])
