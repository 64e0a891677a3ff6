"""Semantic cache: lookups, sweeps, key quality and the keep-or-cut verdict."""

from pyspark.sql import functions as F

from streamlens.operators import cache
from streamlens.operators.layout import join_on
from streamlens.operators.policies import FixedInterval
from streamlens.operators.scoring import with_splits
from streamlens.operators.triggers import decisions
from streamlens.plans.registry import EV, FR, dot, lng, query, r
from streamlens.plans.scalar import rd
from streamlens.sources import tables

PERIOD = 0.1  # seconds between triggers on 30-row-a-second frames
THRESHOLDS = [None, 0.05, 0.1, 0.2, 0.3]


def signal_frames(spark, path):
    zero = F.lit(0.0)
    return tables.frames(spark, path).transform(
        lambda d: d.withColumns({"motion": zero, "novelty": zero, "scene_change": zero, "state_id": F.col("state_id").cast("long")}))


def served(spark, path, thresholds=THRESHOLDS, size=8, max_age=1.0):
    return cache.lookups(signal_frames(spark, path), FixedInterval(PERIOD), thresholds, size, max_age)


SIZE, MAX_AGE = 8, 1.0


def cache_rec(thresholds: str) -> str:
    """The cache followed trigger by trigger: ``es`` is the list of entries, oldest first, for every threshold of a list."""
    sims = f"list_transform(c.es, lambda v: {dot('v.e', 'q.e')})"
    return f"""RECURSIVE {FR}, k AS (SELECT stream_id, CAST(frame_idx AS BIGINT) AS f, t, e, CAST(state_id AS BIGINT) AS state_id FROM fr),
g AS (SELECT stream_id, f, t AS tl, true AS fired FROM k WHERE f = 0 UNION ALL SELECT stream_id, f, CASE WHEN go THEN t ELSE tl END, go FROM (SELECT k.stream_id, k.f, k.t, g.tl, k.t - g.tl >= {PERIOD} AS go FROM g JOIN k ON k.stream_id = g.stream_id AND k.f = g.f + 1) x),
q AS (SELECT k.*, row_number() OVER (PARTITION BY k.stream_id ORDER BY k.f) AS n FROM k JOIN g ON g.stream_id = k.stream_id AND g.f = k.f WHERE fired),
th AS (SELECT unnest({thresholds}::DOUBLE[]) AS thr),
c AS (
 SELECT stream_id, thr, n, f, t, state_id, [{{'e': e, 'f': f, 's': state_id, 't': t, 'h': 0}}] AS es, false AS hit, CAST(NULL AS DOUBLE) AS sim, f AS ef, state_id AS est, t AS et, 0 AS ev FROM q, th WHERE n = 1
 UNION ALL
 SELECT stream_id, thr, n, f, t, state_id,
  CASE WHEN pos IS NOT NULL THEN list_transform(range(1, len(es) + 1), lambda i: CASE WHEN i = pos THEN {{'e': es[i].e, 'f': es[i].f, 's': es[i].s, 't': es[i].t, 'h': es[i].h + 1}} ELSE es[i] END)
       WHEN len(es) < {SIZE} THEN es2 ELSE list_concat(es2[1:victim - 1], es2[victim + 1:]) END,
  pos IS NOT NULL, CASE WHEN pos IS NOT NULL THEN sims[pos] ELSE list_max(sims) END,
  CASE WHEN pos IS NOT NULL THEN es[pos].f ELSE f END, CASE WHEN pos IS NOT NULL THEN es[pos].s ELSE state_id END, CASE WHEN pos IS NOT NULL THEN es[pos].t ELSE t END,
  CASE WHEN pos IS NULL AND len(es) >= {SIZE} THEN 1 ELSE 0 END
 FROM (SELECT *, CASE WHEN list_max(usable) IS NOT NULL THEN list_position(usable, list_max(usable)) END AS pos, list_position(rank, list_min(rank)) AS victim FROM (
  SELECT *, list_transform(range(1, len(es) + 1), lambda i: CASE WHEN sims[i] >= thr AND t - es[i].t <= {MAX_AGE} THEN sims[i] END) AS usable,
   list_transform(es2, lambda v: {{'h': v.h, 't': v.t}}) AS rank FROM (
   SELECT q.stream_id, c.thr, q.n, q.f, q.t, q.state_id, c.es, list_append(c.es, {{'e': q.e, 'f': q.f, 's': q.state_id, 't': q.t, 'h': 0}}) AS es2, {sims} AS sims
   FROM c JOIN q ON q.stream_id = c.stream_id AND q.n = c.n + 1) w) y) z)"""


CACHE_ROWS = f"""stream_id, thr AS cache_threshold, f AS frame_idx, {r('t', 't')}, state_id, hit, {r('sim', 'similarity')}, ef AS evidence_frame, est AS evidence_state,
 {r('et', 'evidence_t')}, {lng('ev', 'evictions')}, {lng('len(es)', 'entries')}"""
ALL_THR = "[0.05, 0.1, 0.2, 0.3]"
#: The run without a cache: every trigger is a call.
WITHOUT = "SELECT stream_id, CAST(NULL AS DOUBLE) AS thr, f, t, state_id, false AS hit, CAST(NULL AS DOUBLE) AS sim, f AS ef, state_id AS est, t AS et, 0 AS ev, 0 AS n_entries FROM q"
BOTH = f"a AS ({WITHOUT} UNION ALL SELECT stream_id, thr, f, t, state_id, hit, sim, ef, est, et, ev, len(es) FROM c)"
REPLAY = """held AS (SELECT s.thr, fr.stream_id, fr.frame_idx, fr.state_id, last_value(a.ef IGNORE NULLS) OVER w AS hf, last_value(a.est IGNORE NULLS) OVER w AS hs
 FROM (SELECT DISTINCT thr FROM a) s CROSS JOIN fr LEFT JOIN a ON a.stream_id = fr.stream_id AND a.f = fr.frame_idx AND a.thr IS NOT DISTINCT FROM s.thr WINDOW w AS (PARTITION BY s.thr, fr.stream_id ORDER BY fr.frame_idx)),
hs AS (SELECT thr, stream_id, count(*) AS n_rows, avg(CASE WHEN hs = state_id THEN 1.0 ELSE 0.0 END) FILTER (frame_idx >= 15) AS validity, avg((frame_idx - hf) / 30.0::DOUBLE * 1000.0) FILTER (frame_idx >= 15) AS stale FROM held GROUP BY ALL),
st AS (SELECT thr, stream_id, count(*) AS n_triggers, count(*) FILTER (NOT hit) AS n_calls, count(*) FILTER (hit) AS n_hits, count(*) FILTER (hit AND est <> state_id) AS false_hits, sum(ev) AS evictions FROM a GROUP BY ALL),
rp AS (SELECT st.*, n_rows, validity, stale, n_triggers - n_calls AS avoided, 100.0::DOUBLE * (n_triggers - n_calls) / n_triggers AS pct, n_hits::DOUBLE / n_triggers AS hit_rate,
  CASE WHEN n_hits > 0 THEN false_hits::DOUBLE / n_hits END AS false_rate, n_calls / (n_rows / 30.0::DOUBLE / 60.0) AS cpm FROM st JOIN hs ON hs.stream_id = st.stream_id AND hs.thr IS NOT DISTINCT FROM st.thr)"""
SWEEP = f"""tab AS (SELECT thr AS cache_threshold, split, count(*) AS n_streams, avg(cpm) AS calls_per_min_mean, avg(pct) AS calls_avoided_pct_mean, sum(avoided) AS calls_avoided_total,
 sum(n_triggers) AS n_triggers_total, avg(hit_rate) AS hit_rate_mean, sum(false_hits) AS false_hits_total, avg(false_rate) AS false_hit_rate_mean, avg(validity) AS validity_mean, avg(stale) AS staleness_ms_mean
 FROM (SELECT *, unnest(['all', CASE WHEN stream_id % 3 = 0 THEN 'held_out' ELSE 'train' END]) AS split FROM rp) GROUP BY ALL)"""


def rounded_lookups(d):
    return d.withColumns({c: F.round(c, 6) for c in ("t", "similarity", "evidence_t")})


@query("e1_cache_lookup", f"WITH {cache_rec('[0.2]')} SELECT stream_id, f AS frame_idx, hit, ef AS evidence_frame FROM c")
def e1(spark, path):
    return served(spark, path, [0.2]).select("stream_id", "frame_idx", "hit", "evidence_frame")


@query("e1_bounded_cache_lookup", f"WITH {cache_rec(ALL_THR)}, {BOTH} SELECT stream_id, thr AS cache_threshold, f AS frame_idx, {r('t', 't')}, state_id, hit, {r('sim', 'similarity')}, ef AS evidence_frame, est AS evidence_state, {r('et', 'evidence_t')}, {lng('ev', 'evictions')}, {lng('n_entries', 'entries')} FROM a")
def e1_bounded(spark, path):
    return rounded_lookups(served(spark, path))


@query("e2_replay_with_cache", f"""WITH {cache_rec('[0.2]')}, a AS (SELECT * FROM c), {REPLAY}
SELECT stream_id, n_triggers, n_calls, n_hits, false_hits, {lng('evictions', 'evictions')}, {r('validity', 'validity')}, {r('stale', 'staleness_ms_mean')} FROM rp""")
def e2(spark, path):
    d = cache.replay(signal_frames(spark, path), served(spark, path, [0.2]), [0.2])
    return d.select("stream_id", "n_triggers", "n_calls", "n_hits", "false_hits", "evictions", rd(F.col("validity"), "validity"), rd(F.col("staleness_ms_mean"), "staleness_ms_mean"))


def cache_table(spark, path):
    laid = signal_frames(spark, path)
    d = cache.replay(laid, served(spark, path), THRESHOLDS)
    return cache.sweep_table(with_splits(d, F.col("stream_id") % 3 == 0), ["cache_threshold", "split"])


MEANS = ("calls_per_min_mean", "calls_avoided_pct_mean", "hit_rate_mean", "false_hit_rate_mean", "validity_mean", "staleness_ms_mean")


@query("e3_cache_sweep", f"""WITH {cache_rec(ALL_THR)}, {BOTH}, {REPLAY}, {SWEEP} SELECT cache_threshold, split, n_streams, {lng('calls_avoided_total', 'calls_avoided_total')}, {lng('n_triggers_total', 'n_triggers_total')},
 {lng('false_hits_total', 'false_hits_total')}, {', '.join(r(c, c) for c in MEANS)} FROM tab""")
def e3(spark, path):
    return cache_table(spark, path).withColumns({c: F.round(c, 6) for c in MEANS})


@query("e4_best_similarity", f"""WITH {FR}, b AS (SELECT a.stream_id, a.frame_idx, max({dot('a.e', 'b.e')}) AS best FROM fr a JOIN fr b ON a.stream_id = b.stream_id AND b.frame_idx < a.frame_idx GROUP BY ALL)
SELECT stream_id, frame_idx, {r('best', 'best_similarity')} FROM b""")
def e4(spark, path):
    return cache.best_earlier_similarity(tables.frames(spark, path)).select("stream_id", "frame_idx", rd(F.col("best_similarity"), "best_similarity"))


TRIGGERS = cache_rec("[0.2]")[: cache_rec("[0.2]").index("th AS (")]


@query("e4_best_at_trigger", f"""WITH {TRIGGERS} b AS (SELECT a.stream_id, a.f, max({dot('a.e', 'b.e')}) AS s FROM q a JOIN q b ON a.stream_id = b.stream_id AND b.f < a.f GROUP BY ALL)
SELECT stream_id, count(*) AS n, {r('max(s)', 'max_similarity')}, {r('quantile_cont(s, 0.5)', 'median_similarity')} FROM b GROUP BY stream_id
UNION ALL SELECT NULL, count(*), {r('max(s)', 'max_similarity')}, {r('quantile_cont(s, 0.5)', 'median_similarity')} FROM b""")
def e4_trigger(spark, path):
    laid = signal_frames(spark, path)
    fired = decisions(laid, [FixedInterval(PERIOD)]).select("stream_id", "frame_idx")
    rows = laid.with_df(join_on(laid.df, fired, ["stream_id", "frame_idx"], "left_semi"))
    d = cache.similarity_summary(cache.best_earlier_similarity(rows), ["stream_id"])
    return d.select("stream_id", "n", rd(F.col("max_similarity"), "max_similarity"), rd(F.col("median_similarity"), "median_similarity"))


@query("e5_key_quality", f"""WITH {FR}, n AS (SELECT stream_id, count(*) AS n FROM fr GROUP BY 1), k AS (SELECT stream_id, n, unnest(range(0, 4000)) AS k FROM n),
ij AS (SELECT stream_id, k, CAST(floor((k * s1 - floor(k * s1)) * n) AS BIGINT) AS i, CAST(floor((k * s2 - floor(k * s2)) * n) AS BIGINT) AS j FROM k, (SELECT 0.6180339887498949::DOUBLE AS s1, 0.7548776662466927::DOUBLE AS s2)),
p AS (SELECT ij.stream_id, {dot('a.e', 'b.e')} AS s, a.state_id = b.state_id AS same FROM ij JOIN fr a ON a.stream_id = ij.stream_id AND a.frame_idx = i JOIN fr b ON b.stream_id = ij.stream_id AND b.frame_idx = j WHERE i <> j),
rk AS (SELECT *, rank() OVER (PARTITION BY stream_id ORDER BY s) + (count(*) OVER (PARTITION BY stream_id, s) - 1) / 2.0::DOUBLE AS rk FROM p),
x AS (SELECT stream_id, sum(rk) FILTER (same) AS rs, count(*) FILTER (same) AS np, count(*) FILTER (NOT same) AS nn, quantile_cont(s, 0.5) FILTER (same) AS sm, quantile_cont(s, 0.1) FILTER (same) AS s10, quantile_cont(s, 0.5) FILTER (NOT same) AS dm, quantile_cont(s, 0.9) FILTER (NOT same) AS d90 FROM rk GROUP BY 1)
SELECT stream_id, {r('(rs - np * (np + 1) / 2.0::DOUBLE) / (np * nn)', 'auc', 5)}, {r('sm', 'same_median', 5)}, {r('s10', 'same_p10', 5)}, {r('dm', 'diff_median', 5)}, {r('d90', 'diff_p90', 5)} FROM x WHERE np > 0 AND nn > 0""")
def e5(spark, path):
    q = cache.key_quality(cache.key_pairs(tables.frames(spark, path)), ["stream_id"])
    return q.withColumns({c: F.round(c, 5) for c in ("auc", "same_median", "same_p10", "diff_median", "diff_p90")})


@query("e6_cache_verdict", f"""WITH {cache_rec(ALL_THR)}, {BOTH}, {REPLAY}, {SWEEP}, h AS (SELECT * FROM tab WHERE split = 'held_out'),
b AS (SELECT validity_mean AS v, calls_per_min_mean AS c FROM h WHERE cache_threshold IS NULL),
s AS (SELECT h.* FROM h, b WHERE cache_threshold IS NOT NULL AND validity_mean >= b.v - 1e-9 ORDER BY calls_avoided_pct_mean DESC, cache_threshold LIMIT 1),
y AS (SELECT * FROM h WHERE cache_threshold IS NOT NULL ORDER BY calls_avoided_pct_mean DESC, cache_threshold LIMIT 1)
SELECT CASE WHEN b.v IS NULL THEN 'inconclusive' WHEN s.calls_avoided_pct_mean >= 10 THEN 'keep' ELSE 'cut' END AS recommendation, {r('b.v', 'baseline_validity')}, {r('b.c', 'baseline_calls_per_min')},
 {r('s.cache_threshold', 'best_lossless_threshold')}, {r('s.calls_avoided_pct_mean', 'best_lossless_avoided_pct')}, {r('y.cache_threshold', 'best_any_threshold')}, {r('y.calls_avoided_pct_mean', 'best_any_avoided_pct')}
FROM y LEFT JOIN b ON true LEFT JOIN s ON true""")
def e6(spark, path):
    v = cache.verdict(cache_table(spark, path).filter("split = 'held_out'"))
    return v.select("recommendation", *[rd(F.col(c), c) for c in v.columns if c != "recommendation"])


BY_HOUR = f"""{EV}, t AS (SELECT CASE WHEN hour(make_timestamp(t_us)) = 0 THEN NULL ELSE hour(make_timestamp(t_us)) / 24.0::DOUBLE END AS thr, avg(value) / 500 AS v, max(value) / 10 AS a, count(*)::DOUBLE AS c FROM ev GROUP BY 1)"""


@query("e6_verdict_rule", f"""WITH {BY_HOUR}, b AS (SELECT v, c FROM t WHERE thr IS NULL), s AS (SELECT t.* FROM t, b WHERE thr IS NOT NULL AND t.v >= b.v - 1e-9 ORDER BY a DESC, thr LIMIT 1), y AS (SELECT * FROM t WHERE thr IS NOT NULL ORDER BY a DESC, thr LIMIT 1)
SELECT CASE WHEN b.v IS NULL THEN 'inconclusive' WHEN s.a >= 10 THEN 'keep' ELSE 'cut' END AS recommendation, {r('b.v', 'baseline_validity')}, {r('b.c', 'baseline_calls_per_min')}, {r('s.thr', 'best_lossless_threshold')}, {r('s.a', 'best_lossless_avoided_pct')},
 {r('y.thr', 'best_any_threshold')}, {r('y.a', 'best_any_avoided_pct')} FROM y LEFT JOIN b ON true LEFT JOIN s ON true""")
def e6_rule(spark, path):
    e = tables.events(spark, path)
    hour = F.floor(F.col("t_us") / 3_600_000_000) % 24
    t = e.groupBy(F.when(hour > 0, hour / 24.0).alias("cache_threshold")).agg(
        (F.avg("value") / 500).alias("validity_mean"), (F.max("value") / 10).alias("calls_avoided_pct_mean"), F.count("*").cast("double").alias("calls_per_min_mean"))
    v = cache.verdict(t)
    return v.select("recommendation", *[rd(F.col(c), c) for c in v.columns if c != "recommendation"])


@query("e7_cache_statistics", f"""WITH {cache_rec('[0.2]')} SELECT stream_id, count(*) AS n_lookups, count(*) FILTER (hit) AS n_hits, {r('count(*) FILTER (hit)::DOUBLE / count(*)', 'hit_rate')}, {lng('sum(ev)', 'n_evictions')}, {lng('max_by(len(es), n)', 'n_entries')} FROM c GROUP BY 1""")
def e7(spark, path):
    s = cache.statistics(served(spark, path, [0.2]), ["stream_id"])
    return s.withColumn("hit_rate", F.round("hit_rate", 6))
