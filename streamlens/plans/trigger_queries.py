"""Trigger policies and sweeps."""

from pyspark.sql import functions as F

from streamlens.operators import inference, training
from streamlens.operators.policies import (AdaptiveQuantile, FixedInterval, InformationGain, Learned, Policy, dense_grid,
                                           make_policy, register_policy)
from streamlens.operators.scoring import across_streams, with_splits
from streamlens.operators.sweep import sweep
from streamlens.operators.triggers import decisions, in_flight, matched_timer
from streamlens.plans.registry import FR, TR, content, f1, query, r
from streamlens.plans.scalar import rd
from streamlens.plans.signal_queries import MOVES, WIN_H
from streamlens.sources import tables

H = 3600.0
GAP = 6 * H
DAY = 24 * H
WEIGHTS, BIAS = [3.0, 0.5, 1.0, 0.2, 2.0], -1.0


def rec(cond: str, policies: str = "(0, 0.0)", extra: str = "") -> str:
    """Recursive SQL of a policy: first row fires, then ``cond`` over row k, state s and policy p."""
    return f"""RECURSIVE {TR}, p(pid, point) AS (VALUES {policies}), k AS (SELECT tr.*, CAST(frame_idx AS BIGINT) AS f{extra} FROM tr),
s AS (
  SELECT pid, point::DOUBLE AS point, stream_id, f, t AS tl, novelty AS vl, true AS fired, 1.0::DOUBLE AS gain FROM k, p WHERE f = 0
  UNION ALL
  SELECT pid, point, stream_id, f, CASE WHEN go THEN t ELSE tl END, CASE WHEN go THEN novelty ELSE vl END, go, 1.0 FROM (
    SELECT s.pid, s.point, k.stream_id, k.f, k.t, k.novelty, s.tl, s.vl, ({cond}) AS go
    FROM s JOIN k ON k.stream_id = s.stream_id AND k.f = s.f + 1) x)"""


def fired_sql(cond: str, name: str, points: list[float], extra: str = "") -> str:
    vals = ", ".join(f"({i}, {p})" for i, p in enumerate(points))
    return f"WITH {rec(cond, vals, extra)} SELECT stream_id, {name} AS policy, point, f AS frame_idx FROM s WHERE fired"


def fired(spark, path, policies):
    return decisions(tables.trace(spark, path), policies).select("stream_id", "policy", "point", "frame_idx")


@query("d1_fixed_interval", fired_sql("s.point <= 0 OR k.t - s.tl >= s.point", "CASE WHEN point <= 0 THEN 'oracle' ELSE 'fixed_' || CAST(CAST(point AS BIGINT) AS VARCHAR) || 's' END", [0.0, GAP, DAY]))
def d1(spark, path):
    return fired(spark, path, [FixedInterval(p) for p in (0.0, GAP, DAY)])


@query("d2_motion_threshold", fired_sql(f"k.t - s.tl >= {GAP} AND k.motion >= s.point", "'motion_threshold'", [0.05, 0.2]))
def d2(spark, path):
    return fired(spark, path, [make_policy("motion_threshold", v, min_gap_s=GAP) for v in (0.05, 0.2)])


NOVELTY_COND = f"k.t - s.tl >= {GAP} AND k.novelty >= s.point"


@query("d3_novelty_threshold", fired_sql(NOVELTY_COND, "'embedding_novelty'", [0.1, 0.3]))
def d3(spark, path):
    return fired(spark, path, [make_policy("embedding_novelty", v, min_gap_s=GAP) for v in (0.1, 0.3)])


GAIN_COND = f"k.t - s.tl >= {GAP} AND greatest(0.0, k.novelty - s.vl) * (0.5 + 0.5 * (1 - pow(0.5, (k.t - s.tl) / {DAY}))) >= s.point"


@query("d4_information_gain", fired_sql(GAIN_COND, "'information_gain'", [0.02, 0.1]))
def d4(spark, path):
    return fired(spark, path, [InformationGain(v, DAY, GAP) for v in (0.02, 0.1)])


THR = f""", CASE WHEN count(*) OVER (PARTITION BY stream_id ORDER BY t_us RANGE BETWEEN {WIN_H * 3_600_000_000} PRECEDING AND CURRENT ROW) >= 10
  THEN quantile_cont(novelty, 0.8) OVER (PARTITION BY stream_id ORDER BY t_us RANGE BETWEEN {WIN_H * 3_600_000_000} PRECEDING AND CURRENT ROW) END AS thr"""
ADAPT_COND = f"k.t - s.tl >= {GAP} AND k.novelty >= 0.02 AND coalesce(k.novelty >= k.thr, false)"


@query("d5_adaptive_quantile", fired_sql(ADAPT_COND, "'adaptive_novelty'", [0.8], THR))
def d5(spark, path):
    return fired(spark, path, [AdaptiveQuantile(0.8, WIN_H * H, GAP, 10, 0.02)])


LEARN_COND = f"""k.t - s.tl >= {GAP} AND 1 / (1 + exp(-greatest(-60.0, least(60.0, 3.0 * k.novelty + 0.5 * k.scene_change + 1.0 * k.motion
 + 0.2 * (least(k.t - s.tl, 30.0) / 10.0) + 2.0 * greatest(0.0, k.novelty - s.vl) - 1.0)))) >= s.point"""


@query("d6_learned", fired_sql(LEARN_COND, "'learned'", [0.5, 0.7]))
def d6(spark, path):
    return fired(spark, path, [Learned(WEIGHTS, BIAS, v, GAP) for v in (0.5, 0.7)])


class EveryRise(Policy):
    """A user policy written row by row: fires when novelty reaches a cut-point, at most every gap."""

    kind = "every_rise"

    def __init__(self, value: float, min_gap_s: float = 0.3) -> None:
        self.point, self.min_gap_s = value, min_gap_s

    def decide(self, ctx):
        return ctx.t_last_call is None or (ctx.since_last_call >= self.min_gap_s and ctx.novelty >= self.point), ctx.novelty


@query("d7_policy_registry", fired_sql(NOVELTY_COND, "'every_rise'", [0.1, 0.3]))
def d7(spark, path):
    register_policy("every_rise", EveryRise)
    return fired(spark, path, [make_policy("every_rise", v, min_gap_s=GAP) for v in (0.1, 0.3)])


@query("k3_policy_plug_in", fired_sql(NOVELTY_COND, "'every_rise'", [0.2]))
def k3(spark, path):
    return fired(spark, path, [EveryRise(0.2, GAP)])


# -- sweeps -----------------------------------------------------------------------------------
def score_sql(with_split: bool) -> str:
    """Scoring of the recursion's decisions ``s`` (30 rows a second, 15 warm-up rows)."""
    return f"""{MOVES},
c AS (SELECT s.pid, s.stream_id, s.f, tr.state_id, lag(tr.state_id) OVER (PARTITION BY s.pid, s.stream_id ORDER BY s.f) AS pc FROM s JOIN tr ON tr.stream_id = s.stream_id AND tr.frame_idx = s.f WHERE fired),
h AS (SELECT pid, s.stream_id, s.f, tr.state_id, max(CASE WHEN fired THEN s.f END) OVER w AS hf FROM s JOIN tr ON tr.stream_id = s.stream_id AND tr.frame_idx = s.f WINDOW w AS (PARTITION BY pid, s.stream_id ORDER BY s.f)),
g AS (SELECT pid, h.stream_id, h.f, (h.f - hf) / 30.0::DOUBLE * 1000.0 AS stale, CASE WHEN t2.state_id = h.state_id THEN 1.0 ELSE 0.0 END AS valid FROM h JOIN tr t2 ON t2.stream_id = h.stream_id AND t2.frame_idx = h.hf),
gs AS (SELECT pid, stream_id, count(*) AS n_rows, avg(valid) FILTER (f >= 15) AS validity, avg(stale) FILTER (f >= 15) AS staleness FROM g GROUP BY ALL),
cs AS (SELECT pid, stream_id, count(*) AS n_calls, count(*) FILTER (state_id = pc) AS n_false, count(*) FILTER (state_id <> pc) AS n_just FROM c GROUP BY ALL),
cv AS (SELECT p.pid, mv.stream_id, mv.frame_idx, (SELECT min(c.f) FROM c WHERE c.pid = p.pid AND c.stream_id = mv.stream_id AND c.state_id = mv.state_id AND c.f >= mv.frame_idx) AS hit_at FROM mv, p),
ev2 AS (SELECT pid, stream_id, count(*) AS n_events, count(hit_at) AS n_cov, avg((hit_at - frame_idx) / 30.0::DOUBLE * 1000.0) AS delay FROM cv GROUP BY ALL),
sc AS (SELECT pid, stream_id, n_rows, n_calls, n_calls / (n_rows / 30.0::DOUBLE / 60.0) AS calls_per_min, n_calls::DOUBLE / n_rows AS call_fraction, validity, staleness AS staleness_ms_mean,
 CASE WHEN n_false + n_just > 0 THEN n_false::DOUBLE / (n_false + n_just) END AS false_trigger_rate, n_false, n_just, n_events, n_cov, delay, CASE WHEN n_events > 0 THEN n_cov::DOUBLE / n_events END AS event_recall
 FROM gs JOIN cs USING (pid, stream_id) LEFT JOIN ev2 USING (pid, stream_id))"""


POLICIES = (
    [("fixed_interval", v, FixedInterval(v)) for v in (0.0, GAP, DAY, 2 * DAY)]
    + [("embedding_novelty", v, make_policy("embedding_novelty", v, min_gap_s=GAP)) for v in (0.05, 0.1, 0.2, 0.3)]
    + [("motion_threshold", v, make_policy("motion_threshold", v, min_gap_s=GAP)) for v in (0.05, 0.1, 0.2)]
    + [("adaptive_novelty", 0.8, AdaptiveQuantile(0.8, WIN_H * H, GAP, 10, 0.02))]
    + [("information_gain", v, InformationGain(v, DAY, GAP)) for v in (0.02, 0.1)]
    + [("learned", v, Learned(WEIGHTS, BIAS, v, GAP)) for v in (0.5, 0.7)]
)
KIND_SQL = "CASE " + " ".join(f"WHEN pid = {i} THEN '{k}'" for i, (k, _, _) in enumerate(POLICIES)) + " END"
SWEEP_COND = f"""CASE WHEN s.pid < 4 THEN s.point <= 0 OR k.t - s.tl >= s.point WHEN s.pid < 8 THEN {NOVELTY_COND} WHEN s.pid < 11 THEN k.t - s.tl >= {GAP} AND k.motion >= s.point
 WHEN s.pid < 12 THEN {ADAPT_COND} WHEN s.pid < 14 THEN {GAIN_COND} ELSE {LEARN_COND} END"""
SWEEP = rec(SWEEP_COND, ", ".join(f"({i}, {v})" for i, (_, v, _) in enumerate(POLICIES)), THR)
HELD_OUT_SQL = "stream_id % 3 = 0"

MEANS = {"validity_mean": "avg(validity)", "validity_std": "stddev_pop(validity)", "validity_min": "min(validity)", "calls_per_min_mean": "avg(calls_per_min)",
         "calls_per_min_std": "stddev_pop(calls_per_min)", "call_fraction_mean": "avg(call_fraction)", "false_trigger_rate_mean": "avg(false_trigger_rate)",
         "event_recall_mean": "avg(event_recall)", "staleness_ms_mean": "avg(staleness_ms_mean)"}
SPLITS = f"sp AS (SELECT sc.*, 'all' AS split FROM sc UNION ALL SELECT sc.*, CASE WHEN {HELD_OUT_SQL} THEN 'held_out' ELSE 'train' END FROM sc)"
TABLE_SQL = f"""SELECT {KIND_SQL} AS kind, point::DOUBLE AS point, split, count(*) AS n_streams, {', '.join(r(e, n) for n, e in MEANS.items())} FROM sp JOIN p USING (pid) GROUP BY pid, point, split"""


def sweep_scores(spark, path):
    return sweep(tables.trace(spark, path), [p for _, _, p in POLICIES])


def rounded(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def sweep_table(spark, path):
    held = F.col("stream_id") % 3 == 0
    return across_streams(with_splits(sweep_scores(spark, path), held), ["kind", "point", "split"])


@query("d8_policy_sweep", f"WITH {SWEEP}, {score_sql(True)}, {SPLITS} {TABLE_SQL}")
def d8(spark, path):
    return rounded(sweep_table(spark, path), MEANS)


@query("d8_sweep_per_stream", f"""WITH {SWEEP}, {score_sql(False)} SELECT stream_id, {KIND_SQL} AS kind, point::DOUBLE AS point, n_rows, n_calls, {r('calls_per_min', 'calls_per_min')}, {r('validity', 'validity')},
 {r('staleness_ms_mean', 'staleness_ms_mean')}, n_false AS false_triggers, n_just AS justified_calls, {r('false_trigger_rate', 'false_trigger_rate')}, n_events - n_cov AS missed_events, n_events AS total_events,
 {r('event_recall', 'event_recall')}, {r('delay', 'detection_delay_ms_mean')} FROM sc JOIN p USING (pid)""")
def d8_streams(spark, path):
    s = sweep_scores(spark, path).drop("policy", "call_fraction", "accuracy")
    return rounded(s, ["calls_per_min", "validity", "staleness_ms_mean", "false_trigger_rate", "event_recall", "detection_delay_ms_mean"])


TEXT_SQL = f"""tok AS (SELECT answer, {content('answer')} AS w FROM (SELECT DISTINCT answer FROM tr)), pr AS (SELECT a.answer AS a, b.answer AS b, {f1('a.w', 'b.w')} AS f1 FROM tok a, tok b),
gt AS (SELECT pid, h.stream_id, avg(coalesce(pr.f1, 0.0)) FILTER (h.f >= 15) AS accuracy, quantile_cont((h.f - hf) / 30.0::DOUBLE * 1000.0, 0.95) FILTER (h.f >= 15 AND hf IS NOT NULL) AS s95
 FROM h JOIN tr n ON n.stream_id = h.stream_id AND n.frame_idx = h.f LEFT JOIN tr o ON o.stream_id = h.stream_id AND o.frame_idx = h.hf LEFT JOIN pr ON pr.a = o.answer AND pr.b = n.answer GROUP BY ALL)"""
TEXT_MEANS = {"accuracy_mean": "avg(accuracy)", "accuracy_std": "stddev_pop(accuracy)", "accuracy_min": "min(accuracy)", "staleness_ms_p95_mean": "avg(s95)"}


@query("d8_sweep_with_text", f"WITH {SWEEP}, {score_sql(True)}, {TEXT_SQL} SELECT stream_id, {KIND_SQL} AS kind, point::DOUBLE AS point, {r('accuracy', 'accuracy')}, {r('s95', 'staleness_ms_p95')} FROM gt JOIN p USING (pid)")
def d8_text(spark, path):
    s = sweep(tables.trace(spark, path), [p for _, _, p in POLICIES], with_text=True)
    return rounded(s.select("stream_id", "kind", "point", "accuracy", "staleness_ms_p95"), ["accuracy", "staleness_ms_p95"])


@query("d8_text_across_streams", f"WITH {SWEEP}, {score_sql(True)}, {TEXT_SQL} SELECT {KIND_SQL} AS kind, point::DOUBLE AS point, count(*) AS n_streams, {', '.join(r(e, n) for n, e in TEXT_MEANS.items())} FROM gt JOIN p USING (pid) GROUP BY pid, point")
def d8_text_table(spark, path):
    s = sweep(tables.trace(spark, path), [p for _, _, p in POLICIES], with_text=True)
    return rounded(across_streams(s, ["kind", "point"]).select("kind", "point", "n_streams", *TEXT_MEANS), TEXT_MEANS)


DENSE = [("embedding_novelty", v) for v in dense_grid("embedding_novelty")] + [("motion_threshold", v) for v in dense_grid("motion_threshold")]
N_NOV = len(dense_grid("embedding_novelty"))
DENSE_REC = rec(f"k.t - s.tl >= {GAP} AND CASE WHEN s.pid < {N_NOV} THEN k.novelty ELSE k.motion END >= s.point", ", ".join(f"({i}, {v})" for i, (_, v) in enumerate(DENSE)))
DENSE_KIND = f"CASE WHEN pid < {N_NOV} THEN 'embedding_novelty' ELSE 'motion_threshold' END"


def dense_scores(spark, path, kinds=("embedding_novelty", "motion_threshold")):
    """Scores of the dense grid's policies of ``kinds``."""
    return sweep(tables.trace(spark, path), [make_policy(k, v, min_gap_s=GAP) for k, v in DENSE if k in kinds])


@query("d9_dense_curves", f"""WITH {DENSE_REC}, {score_sql(False)} SELECT {DENSE_KIND} AS kind, point::DOUBLE AS point, {r('avg(validity)', 'validity_mean')}, {r('min(validity)', 'validity_min')}, {r('avg(calls_per_min)', 'calls_per_min_mean')},
 {r('avg(event_recall)', 'event_recall_mean')} FROM sc JOIN p USING (pid) GROUP BY pid, point""")
def d9(spark, path):
    t = across_streams(dense_scores(spark, path), ["kind", "point"])
    return rounded(t.select("kind", "point", "validity_mean", "validity_min", "calls_per_min_mean", "event_recall_mean"),
                   ["validity_mean", "validity_min", "calls_per_min_mean", "event_recall_mean"])


FULL = rec(NOVELTY_COND, "(0, 0.1)")


@query("d10_budget_matched_timer", f"""WITH {FULL}, n AS (SELECT stream_id, count(*) FILTER (fired) AS c FROM s GROUP BY 1), d AS (SELECT stream_id, (max(t) - min(t)) / 60.0 AS m FROM tr GROUP BY 1),
b AS (SELECT 60.0::DOUBLE / avg(CASE WHEN m > 0 THEN c / m END) AS period FROM n JOIN d USING (stream_id)),
m AS (SELECT k.stream_id, k.f, k.t AS tl, true AS fired FROM k WHERE f = 0 UNION ALL SELECT stream_id, f, CASE WHEN go THEN t ELSE tl END, go FROM (SELECT k.stream_id, k.f, k.t, m.tl, k.t - m.tl >= (SELECT period FROM b) AS go FROM m JOIN k ON k.stream_id = m.stream_id AND k.f = m.f + 1) x)
SELECT stream_id, n.c AS full_calls, count(*) FILTER (m.fired) AS timer_calls FROM m JOIN n USING (stream_id) GROUP BY ALL""")
def d10(spark, path):
    tr = tables.trace(spark, path)
    full = decisions(tr, [make_policy("embedding_novelty", 0.1, min_gap_s=GAP)])
    timer = matched_timer(tr, full)
    a = full.groupBy("stream_id").agg(F.count("*").alias("full_calls"))
    b = decisions(tr, [timer]).groupBy("stream_id").agg(F.count("*").alias("timer_calls"))
    return a.join(b, "stream_id")


@query("d11_in_flight", f"""WITH {rec(f"k.t - s.tl >= {2 * GAP} AND k.novelty >= s.point", "(0, 0.05)")}, b AS (SELECT s.stream_id, s.f, s.fired, lag(s.tl) OVER (PARTITION BY s.stream_id ORDER BY s.f) AS pt FROM s)
SELECT b.stream_id, b.f AS frame_idx, CASE WHEN fired THEN 'started' ELSE 'worker_busy' END AS outcome FROM b JOIN tr ON tr.stream_id = b.stream_id AND tr.frame_idx = b.f
WHERE fired OR (novelty >= 0.05 AND t - pt >= {GAP} AND t - pt < {2 * GAP})""")
def d11(spark, path):
    laid = in_flight(tables.trace(spark, path), make_policy("embedding_novelty", 0.05, min_gap_s=GAP), 2 * GAP)
    return laid.df.select("stream_id", "frame_idx", "outcome")


TEACHER = f"""{TR}, k AS (SELECT *, CAST(frame_idx AS BIGINT) AS f FROM tr),
s AS (SELECT stream_id, f, t AS tl, novelty AS vl, state_id AS sl, 0.0::DOUBLE AS age, 0.0::DOUBLE AS dv, 0.0::DOUBLE AS label FROM k WHERE f = 0
 UNION ALL SELECT stream_id, f, CASE WHEN go THEN t ELSE tl END, CASE WHEN go THEN novelty ELSE vl END, CASE WHEN go THEN state_id ELSE sl END, least(t - tl, 30.0) / 10.0, greatest(0.0, novelty - vl), CASE WHEN go THEN 1.0 ELSE 0.0 END
 FROM (SELECT k.stream_id, k.f, k.t, k.novelty, k.state_id, s.tl, s.vl, s.sl, k.state_id <> s.sl AND k.t - s.tl >= {GAP} AS go FROM s JOIN k ON k.stream_id = s.stream_id AND k.f = s.f + 1) x)"""


@query("d12_teacher_examples", f"""WITH RECURSIVE {TEACHER}
SELECT s.stream_id, s.f AS frame_idx, {r('novelty', 'novelty')}, {r('motion', 'motion')}, {r('age', 'since_last_call')}, {r('dv', 'novelty_delta')}, label FROM s JOIN tr ON tr.stream_id = s.stream_id AND tr.frame_idx = s.f WHERE s.f > 0""")
def d12(spark, path):
    e = training.teacher_examples(tables.trace(spark, path), GAP).drop("scene_change")
    return rounded(e, ["novelty", "motion", "since_last_call", "novelty_delta"])


#: A model to evaluate: weights of the features in their order, and the bias.
FIXED_MODEL = ([2.0, 0.5, 1.0, -0.25, 3.0], -1.0)


@query("d13_evaluate_learned", f"""WITH RECURSIVE {TEACHER}, x AS (SELECT label, 2.0 * novelty + 0.5 * scene_change + 1.0 * motion - 0.25 * age + 3.0 * dv - 1.0 >= 0 AS p, label > 0 AS y
 FROM s JOIN tr ON tr.stream_id = s.stream_id AND tr.frame_idx = s.f WHERE s.f > 0)
SELECT count(*) AS n_examples, count(*) FILTER (y) AS n_positive, {r('avg(label)', 'positive_rate')}, {r('count(*) FILTER (p AND y)::DOUBLE / nullif(count(*) FILTER (p), 0)', 'precision')},
 {r('count(*) FILTER (p AND y)::DOUBLE / nullif(count(*) FILTER (y), 0)', 'recall')} FROM x""")
def d13_evaluate(spark, path):
    d = training.evaluate(training.teacher_examples(tables.trace(spark, path), GAP), *FIXED_MODEL)
    return rounded(d, ["positive_rate", "precision", "recall"])


@query("d13_fit_learned")
def d13(spark, path):
    tr = tables.trace(spark, path)
    train = tr.with_df(tr.df.filter("stream_id % 3 <> 0"))
    fitted = training.fit(training.teacher_examples(train, GAP))
    held = training.evaluate(training.teacher_examples(tr.with_df(tr.df.filter("stream_id % 3 = 0")), GAP), fitted["weights"], fitted["bias"])
    return held.select(F.lit(fitted["n_examples"]).alias("n_train"), F.lit(fitted["precision"]).alias("train_precision"), F.lit(fitted["recall"]).alias("train_recall"),
                       F.array(*[F.lit(w) for w in fitted["weights"]]).alias("weights"), F.lit(fitted["bias"]).alias("bias"),
                       F.col("precision").alias("held_out_precision"), F.col("recall").alias("held_out_recall"))


@query("d13_fit_optimum", f"""WITH RECURSIVE {TEACHER}, x AS (SELECT label FROM s JOIN tr ON tr.stream_id = s.stream_id AND tr.frame_idx = s.f WHERE s.f > 0 AND s.stream_id % 3 <> 0)
SELECT feature, (SELECT count(*) FROM x) AS n_examples, (SELECT count(*) FROM x WHERE label > 0) AS n_positive, true AS level
FROM (VALUES ('novelty'), ('scene_change'), ('motion'), ('since_last_call'), ('novelty_delta'), ('bias')) f(feature)""")
def d13_optimum(spark, path):
    """The loss is level at the fitted weights, in the direction of every weight: nothing else is the optimum of a convex loss."""
    tr = tables.trace(spark, path)
    examples = training.teacher_examples(tr.with_df(tr.df.filter("stream_id % 3 <> 0")), GAP)
    fitted = training.fit(examples)
    slopes = training.slope_at(examples, fitted["weights"], fitted["bias"])
    return slopes.select("feature", F.lit(fitted["n_examples"]).cast("long").alias("n_examples"), F.lit(fitted["n_positive"]).cast("long").alias("n_positive"), (F.abs("slope") < 1e-6).alias("level"))


def load_describer():
    def describe(pdf):
        out = []
        for s in pdf["state_id"]:
            if s == 4:
                raise ValueError("cannot describe state 4")
            out.append(f"scene in state {s}")
        return out

    return describe


@query("d14_trigger_call_answer", f"""WITH {rec(NOVELTY_COND, "(0, 0.1)")} SELECT s.stream_id, s.f AS frame_idx, CASE WHEN state_id <> 4 THEN 'scene in state ' || state_id END AS answer,
CASE WHEN state_id = 4 THEN 'ValueError: cannot describe state 4' END AS error FROM s JOIN tr ON tr.stream_id = s.stream_id AND tr.frame_idx = s.f WHERE fired""")
def d14(spark, path):
    tr = tables.trace(spark, path)
    hits = decisions(tr, [make_policy("embedding_novelty", 0.1, min_gap_s=GAP)]).select("stream_id", "frame_idx")
    rows = tr.df.select("stream_id", "frame_idx", "state_id").join(hits, ["stream_id", "frame_idx"])
    return inference.answer_fired(rows, load_describer, ["stream_id", "frame_idx"])


def load_encoder():
    import numpy as np

    def encode(batch):
        x = np.asarray(batch, dtype=np.float32)
        x = x - x.mean(axis=1, keepdims=True)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    return encode


@query("d15_batch_embedding", f"""WITH {FR}, c AS (SELECT stream_id, frame_idx, list_transform(e, lambda x: x - list_sum(e) / 64) AS v FROM fr), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM c)
SELECT stream_id, frame_idx, {r('v[1] / n', 'first', 4)}, {r('v[64] / n', 'last_dim', 4)} FROM n""")
def d15(spark, path):
    df = inference.embed(tables.frames(spark, path).result().withColumn("embedding", F.col("embedding").cast("array<float>")), load_encoder, "embedding", 64, "encoded")
    return df.select("stream_id", "frame_idx", rd(F.col("encoded")[0].cast("double"), "first", 4), rd(F.col("encoded")[63].cast("double"), "last_dim", 4))
