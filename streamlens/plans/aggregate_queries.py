"""Aggregations: percentile blocks, rates, energy, scores, diagnosis, quality and benches."""

from pyspark.sql import functions as F

from streamlens.functions import text
from streamlens.operators import quality, scoring, telemetry
from streamlens.operators.choose import backlog_stats, thin
from streamlens.operators.layout import lay_out
from streamlens.operators.policies import FixedInterval, make_policy
from streamlens.operators.quantiles import auc, percentile_block
from streamlens.operators.scoring import across_streams, versus
from streamlens.operators.triggers import decisions
from streamlens.plans.join_queries import CALLS, answered, passes, QE
from streamlens.plans.registry import EV, TR, content, f1, lng, query, r, words
from streamlens.plans.scalar import LETTER, SAID, annotation_docs, backend_label, LABELS, rd, said
from streamlens.plans.signal_queries import FIRED, HELD, MOVES, W, fired_trace
from streamlens.plans.trigger_queries import DAY, DENSE_REC, GAP, MEANS, NOVELTY_COND, TEXT_MEANS, dense_scores, rec, rounded, score_sql
from streamlens.sources import annotations, tables, traces
from streamlens.sources.tables import table


def block_sql(keys: str, v: str, src: str, digits: int = 4) -> str:
    fs = {"mean": f"avg({v})", "p50": f"quantile_cont({v}, 0.5)", "p95": f"quantile_cont({v}, 0.95)", "p99": f"quantile_cont({v}, 0.99)", "min": f"min({v})", "max": f"max({v})", "std": f"stddev_pop({v})"}
    return f"SELECT {keys}, count({v}) AS n, {', '.join(r(e, n, digits) for n, e in fs.items())} FROM {src} GROUP BY ALL HAVING count({v}) > 0"


def block(df, keys, v, digits=4, within=None):
    b = percentile_block(df, keys, v, within=within)
    return b.withColumns({c: F.round(c, digits) for c in ("mean", "p50", "p95", "p99", "min", "max", "std")})


@query("g1_percentile_block", f"WITH {CALLS} {block_sql('run_id', 'answer_ms', 'lat', 2)}")
def g1(spark, path):
    fr, calls, _ = tables.call_log(spark, path)
    within = tables.events_laid(spark, path)  # a run's calls are among its events
    return block(telemetry.call_latencies(calls, fr, ["run_id"]), ["run_id"], "answer_ms", 2, within=within)


@query("g1_percentile_block_global", f"WITH {EV}, x AS (SELECT 1 AS one, value FROM ev) SELECT * EXCLUDE (one) FROM ({block_sql('one', 'value', 'x')})")
def g1_global(spark, path):
    return block(tables.events(spark, path), [], "value")


@query("g2_stage_latency", f"WITH {EV} {block_sql('stream_id AS run_id, event_type AS stage', 'value', 'ev', 7)}")
def g2(spark, path):
    laid = tables.events_laid(spark, path)
    s = laid.df.select(F.col("stream_id").alias("run_id"), F.col("event_type").alias("stage"), "value")
    return block(s, ["run_id", "stage"], "value", 7, within=laid)


@query("g3_queue_depth", f"""WITH {EV}, d AS (SELECT stream_id AS run_id, event_type AS queue, CAST(floor(value / 10) AS INTEGER) AS depth FROM ev) SELECT run_id, queue, max(depth) AS max_depth, {r('avg(depth)', 'mean_depth')}, count(*) AS n_samples FROM d GROUP BY ALL""")
def g3(spark, path):
    s = tables.events(spark, path).select(F.col("stream_id").alias("run_id"), F.col("event_type").alias("queue"), F.floor(F.col("value") / 10).cast("int").alias("depth"))
    return telemetry.queue_depth(s, ["run_id", "queue"]).withColumn("mean_depth", F.round("mean_depth", 6))


@query("g3_depth_series", f"""WITH {EV}, d AS (SELECT stream_id AS run_id, event_type AS queue, t, t_us, event_id, CAST(floor(value / 10) AS INTEGER) AS depth FROM ev)
SELECT run_id, queue, row_number() OVER w - 1 AS point, {r('t - first_value(t) OVER w', 't_rel')}, depth FROM d WINDOW w AS (PARTITION BY run_id, queue ORDER BY t_us, event_id)""")
def g3_series(spark, path):
    s = tables.events(spark, path).select(F.col("stream_id").alias("run_id"), F.col("event_type").alias("queue"), "t", "t_us", "event_id", F.floor(F.col("value") / 10).cast("int").alias("depth"))
    return telemetry.depth_points(lay_out(s, ["run_id", "queue"], ["t_us", "event_id"])).withColumn("t_rel", F.round("t_rel", 6))


RUNS = f"""{EV}, rn AS (SELECT stream_id AS run_id, count(*) AS captured, max(t) - min(t) AS duration_s, count(*) FILTER (event_type = 'error') AS dropped, count(*) FILTER (event_type = 'click') AS calls FROM ev GROUP BY 1),
rr AS (SELECT *, dropped::DOUBLE / (captured + dropped) AS drop_rate, CASE WHEN duration_s > 0 THEN captured / duration_s END AS achieved_fps, CASE WHEN duration_s > 0 THEN calls / (duration_s / 60.0) END AS calls_per_min FROM rn)"""


def run_rates(spark, path):
    e = tables.events(spark, path).withColumnRenamed("stream_id", "run_id")
    return telemetry.counts_and_rates(e, e.filter("event_type = 'error'"), e.filter("event_type = 'click'"), ["run_id"])


@query("g4_counts_and_rates", f"WITH {RUNS} SELECT run_id, captured, dropped, calls, {r('duration_s', 'duration_s', 3)}, {r('drop_rate', 'drop_rate')}, {r('achieved_fps', 'achieved_fps', 9)}, {r('calls_per_min', 'calls_per_min', 9)} FROM rr")
def g4(spark, path):
    d = run_rates(spark, path)
    return d.select("run_id", "captured", "dropped", "calls", rd(F.col("duration_s"), "duration_s", 3), rd(F.col("drop_rate"), "drop_rate"), rd(F.col("achieved_fps"), "achieved_fps", 9), rd(F.col("calls_per_min"), "calls_per_min", 9))


def triggers(spark, path):
    """Trigger log: fired on a high value, labelled only on even ids."""
    e = tables.events(spark, path)
    label = F.when(F.col("event_id") % 2 == 0, F.col("event_type") == "purchase")
    return e.select(F.col("stream_id").alias("run_id"), (F.col("value") > 50).alias("fired"), label.alias("semantic_change"))


TRG = f"{EV}, tg AS (SELECT stream_id AS run_id, value > 50 AS fired, CASE WHEN event_id % 2 = 0 THEN event_type = 'purchase' END AS lab FROM ev)"


@query("g5_false_trigger_rate", f"""WITH {TRG}, x AS (SELECT run_id, count(*) FILTER (fired AND lab = false) AS n_false, count(*) FILTER (fired AND lab IS NOT NULL) AS n_labelled, count(*) FILTER (fired AND lab IS NULL) AS n_unlabelled FROM tg GROUP BY 1)
SELECT *, {r('CASE WHEN n_labelled > 0 THEN n_false::DOUBLE / n_labelled END', 'rate')} FROM x""")
def g5(spark, path):
    return telemetry.false_trigger_rate(triggers(spark, path), ["run_id"]).withColumn("rate", F.round("rate", 6))


@query("g6_agreement_rate", f"WITH {TRG} SELECT run_id, {r('avg(CAST(lab AS INTEGER))', 'accuracy_vs_oracle')}, count(*) AS decisions, count(*) FILTER (fired) AS fired FROM tg GROUP BY 1")
def g6(spark, path):
    d = telemetry.agreement(triggers(spark, path), ["run_id"], F.col("semantic_change"), F.col("fired"))
    return d.withColumn("accuracy_vs_oracle", F.round("accuracy_vs_oracle", 6))


G7_SQL = f"""{TR}, {FIRED}, {HELD}, {MOVES},
tok AS (SELECT answer, {content('answer')} AS w FROM (SELECT DISTINCT answer FROM tr)), pr AS (SELECT a.answer AS a, b.answer AS b, {f1('a.w', 'b.w')} AS f1 FROM tok a, tok b),
gg AS (SELECT h.stream_id, h.frame_idx, CASE WHEN hs = state_id THEN 1.0 ELSE 0.0 END AS valid, (frame_idx - hf) / 30.0::DOUBLE * 1000.0 AS stale, coalesce(f1, 0.0) AS f1 FROM h LEFT JOIN pr ON pr.a = ha AND pr.b = answer),
gs AS (SELECT stream_id, count(*) AS n_rows, avg(valid) FILTER (frame_idx >= 15) AS validity, avg(f1) FILTER (frame_idx >= 15) AS accuracy, avg(stale) FILTER (frame_idx >= 15) AS sm, quantile_cont(stale, 0.95) FILTER (frame_idx >= 15 AND stale IS NOT NULL) AS s95 FROM gg GROUP BY 1),
cc AS (SELECT stream_id, state_id, lag(state_id) {W} AS pc FROM f WHERE fired), cs AS (SELECT stream_id, count(*) AS n_calls, count(*) FILTER (state_id = pc) AS nf, count(*) FILTER (state_id <> pc) AS nj FROM cc GROUP BY 1),
cv AS (SELECT mv.stream_id, mv.frame_idx, min(f.frame_idx) AS hit_at FROM mv LEFT JOIN f ON f.stream_id = mv.stream_id AND f.fired AND f.state_id = mv.state_id AND f.frame_idx >= mv.frame_idx GROUP BY ALL),
es AS (SELECT stream_id, count(*) AS ne, count(hit_at) AS nc, avg((hit_at - frame_idx) / 30.0::DOUBLE * 1000.0) AS delay FROM cv GROUP BY 1)"""


@query("g7_policy_score", f"""WITH {G7_SQL} SELECT stream_id, n_rows, coalesce(n_calls, 0) AS n_calls, {r('coalesce(n_calls, 0) / (n_rows / 30.0::DOUBLE / 60.0)', 'calls_per_min')}, {r('coalesce(n_calls, 0)::DOUBLE / n_rows', 'call_fraction')}, {r('validity', 'validity')}, {r('accuracy', 'accuracy')},
{r('sm', 'staleness_ms_mean')}, {r('s95', 'staleness_ms_p95')}, coalesce(nf, 0) AS false_triggers, coalesce(nj, 0) AS justified_calls, {r('CASE WHEN nf + nj > 0 THEN nf::DOUBLE / (nf + nj) END', 'false_trigger_rate')}, ne - nc AS missed_events, ne AS total_events, {r('nc::DOUBLE / ne', 'event_recall')}, {r('delay', 'detection_delay_ms_mean')}
FROM gs LEFT JOIN cs USING (stream_id) LEFT JOIN es USING (stream_id)""")
def g7(spark, path):
    s = scoring.score(fired_trace(spark, path))
    return rounded(s, ["calls_per_min", "call_fraction", "validity", "accuracy", "staleness_ms_mean", "staleness_ms_p95", "false_trigger_rate", "event_recall", "detection_delay_ms_mean"])


@query("g8_across_streams", f"""WITH {G7_SQL}, x AS (SELECT stream_id, n_rows, validity, accuracy, s95, coalesce(n_calls, 0) / (n_rows / 30.0::DOUBLE / 60.0) AS calls_per_min, coalesce(n_calls, 0)::DOUBLE / n_rows AS call_fraction, CASE WHEN nf + nj > 0 THEN nf::DOUBLE / (nf + nj) END AS false_trigger_rate, nc::DOUBLE / ne AS event_recall, sm AS staleness_ms_mean FROM gs LEFT JOIN cs USING (stream_id) LEFT JOIN es USING (stream_id))
SELECT 'novelty' AS policy, count(*) AS n_streams, {', '.join(r(e, n) for n, e in (MEANS | TEXT_MEANS).items())} FROM x""")
def g8(spark, path):
    s = scoring.score(fired_trace(spark, path)).withColumn("policy", F.lit("novelty"))
    return rounded(across_streams(s, ["policy"]), MEANS | TEXT_MEANS)


@query("g9_energy", f"""WITH {EV}, x AS (SELECT stream_id, t, value AS w, greatest(0.0, value - 20.0) AS m, event_id, t_us FROM ev), y AS (SELECT *, lag(t) OVER o AS pt, lag(w) OVER o AS pw, lag(m) OVER o AS pm FROM x WINDOW o AS (PARTITION BY stream_id ORDER BY t_us, event_id)),
q AS (SELECT stream_id, count(*) AS nq FROM ev WHERE event_type = 'click' GROUP BY 1), z AS (SELECT stream_id, count(*) AS n_samples, avg(w) AS mw, max(w) AS xw, sum((t - pt) * (w + pw) / 2.0::DOUBLE) AS e, sum((t - pt) * (m + pm) / 2.0::DOUBLE) AS em, avg(floor(w % 100)) AS mu, CAST(max(floor(w % 40 + 40)) AS INTEGER) AS pt FROM y GROUP BY 1)
SELECT z.stream_id, n_samples, {r('mw', 'mean_w')}, {r('xw', 'peak_w')}, {r('e', 'energy_j', 2)}, {r('em', 'energy_marginal_j', 2)}, {r('e / nq', 'energy_per_query_j', 2)}, {r('em / nq', 'energy_marginal_per_query_j', 2)}, {r('mu', 'mean_util_pct')}, pt AS peak_temp_c FROM z LEFT JOIN q USING (stream_id)""")
def g9(spark, path):
    e = tables.events(spark, path).filter("event_type = 'click'")
    d = telemetry.energy(tables.power_samples(spark, path), F.lit(20.0), e)
    return d.select("stream_id", "n_samples", rd(F.col("mean_w"), "mean_w"), rd(F.col("peak_w"), "peak_w"), *[rd(F.col(c), c, 2) for c in ("energy_j", "energy_marginal_j", "energy_per_query_j", "energy_marginal_per_query_j")], rd(F.col("mean_util_pct"), "mean_util_pct"), "peak_temp_c")


@query("g10_memory", f"WITH {EV}, x AS (SELECT stream_id, CAST(trunc(value * 1e7) AS BIGINT) AS m FROM ev) SELECT stream_id, {r('max(m) / 1073741824.0::DOUBLE', 'peak_used_gb')}, {r('avg(m) / 1073741824.0::DOUBLE', 'mean_used_gb')} FROM x GROUP BY 1")
def g10(spark, path):
    return rounded(telemetry.memory(tables.power_samples(spark, path).df, ["stream_id"]), ["peak_used_gb", "mean_used_gb"])


def auc_sql(src: str, part: str, score: str, pos: str) -> str:
    over = f"PARTITION BY {part} " if part else ""
    sel = f"{part}, " if part else ""
    grp = f"GROUP BY {part}" if part else ""
    return f"""rk AS (SELECT {sel}{pos} AS pos, rank() OVER ({over}ORDER BY {score}) + (count(*) OVER (PARTITION BY {sel}{score}) - 1) / 2.0::DOUBLE AS rk FROM {src}),
ax AS (SELECT {sel}sum(rk) FILTER (pos) AS rs, count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn FROM rk {grp})"""


AUC = "CASE WHEN np > 0 AND nn > 0 THEN (rs - np * (np + 1) / 2.0::DOUBLE) / (np * nn::DOUBLE) END"


@query("g11_auc", f"WITH x AS (SELECT n_chars, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)), {auc_sql('x', '', 'n_chars', 'pos')} SELECT {r(AUC, 'auc')}, np AS n_pos, nn AS n_neg FROM ax")
def g11(spark, path):
    d = table(spark, path, "documents").select("doc_id", "n_chars").join(table(spark, path, "labels"), "doc_id")
    return auc(d.withColumn("pos", F.col("quality") == 1), [], "n_chars", "pos").withColumn("auc", F.round("auc", 6))


SEP = f"""{TR}, {MOVES}, j AS (SELECT tr.stream_id, tr.frame_idx, tr.novelty, tr.motion, tr.scene_change, max(CASE WHEN tr.frame_idx >= mv.frame_idx AND tr.frame_idx < mv.frame_idx + 1 THEN 1 ELSE 0 END) AS ev,
 max(CASE WHEN tr.frame_idx >= mv.frame_idx AND tr.frame_idx < mv.frame_idx + 1 THEN 1 ELSE 0 END) AS near FROM tr LEFT JOIN mv ON tr.stream_id = mv.stream_id GROUP BY ALL),
m AS (SELECT *, ev = 1 AS is_event, near = 0 AND frame_idx >= 15 AS is_quiet FROM j), u AS (SELECT stream_id, is_event, unnest(['novelty', 'motion', 'scene_change']) AS signal, unnest([novelty, motion, scene_change]) AS v FROM m WHERE is_event OR is_quiet),
{auc_sql('u', 'stream_id, signal', 'v', 'is_event')}, q AS (SELECT stream_id, signal, quantile_cont(v, 0.5) FILTER (is_event) AS em, quantile_cont(v, 0.95) FILTER (NOT is_event) AS q95 FROM u GROUP BY ALL),
sep AS (SELECT stream_id, signal, {AUC} AS auc, np, nn, em, q95, em > q95 AS clears FROM ax JOIN q USING (stream_id, signal))"""


@query("g12_separability", f"WITH {SEP} SELECT stream_id, signal, {r('auc', 'auc')}, np AS n_event_rows, nn AS n_quiet_rows, {r('em', 'event_median')}, {r('q95', 'quiet_p95')}, clears FROM sep")
def g12(spark, path):
    d = scoring.separability(tables.trace(spark, path), 1, 0, 15)
    return rounded(d, ["auc", "event_median", "quiet_p95"])


BAR = 0.45
ROOM = f"""cu AS (SELECT stream_id, point AS threshold, validity, calls_per_min, event_recall FROM sc JOIN p USING (pid) WHERE pid < 60),
gl AS (SELECT threshold, min(validity) AS mv, avg(calls_per_min) AS c, avg(event_recall) AS rc FROM cu GROUP BY 1 HAVING min(validity) >= 0.2), gb AS (SELECT * FROM gl ORDER BY c, threshold LIMIT 1),
ow AS (SELECT stream_id, min(struct_pack(c := calls_per_min, t := threshold)) FILTER (validity >= 0.2) AS o FROM cu GROUP BY 1),
pe AS (SELECT count(*) AS n_streams, count(o) AS n_achievable, avg(o.c) AS pc, max(o.t) AS hi, min(o.t) AS lo FROM ow),
room AS (SELECT 0.2::DOUBLE AS validity_bar, gb.threshold AS global_threshold, gb.c AS global_calls_per_min, gb.mv AS global_min_validity, n_streams, n_achievable, n_streams - n_achievable AS n_unreachable, pc AS per_stream_calls_per_min, gb.c / pc AS headroom_x, CASE WHEN n_achievable > 1 THEN hi / greatest(1e-9, lo) END AS threshold_spread FROM pe LEFT JOIN gb ON true)"""
ROOM_COLS = ["global_threshold", "global_calls_per_min", "global_min_validity", "per_stream_calls_per_min", "headroom_x", "threshold_spread"]


def room(spark, path):
    curve = dense_scores(spark, path, ["embedding_novelty"]).withColumnRenamed("point", "threshold")
    return scoring.headroom(curve, ["stream_id"], 0.2)


@query("g13_headroom", f"WITH {DENSE_REC}, {score_sql(False)}, {ROOM} SELECT validity_bar, n_streams, n_achievable, n_unreachable, {', '.join(r(c, c) for c in ROOM_COLS)} FROM room")
def g13(spark, path):
    return rounded(room(spark, path).drop("global_mean_recall"), ROOM_COLS)


@query("g13_stream_headroom", f"""WITH {DENSE_REC}, {score_sql(False)}, {ROOM}, b AS (SELECT stream_id, max(validity) AS bv, min(struct_pack(c := calls_per_min, t := threshold, v := validity, rc := event_recall)) FILTER (validity >= {BAR}) AS o FROM cu GROUP BY 1)
SELECT stream_id, o IS NOT NULL AS reachable, {r('bv', 'best_validity')}, {r('o.t', 'threshold')}, {r('o.c', 'calls_per_min')}, {r('o.rc', 'event_recall')} FROM b""")
def g13_streams(spark, path):
    curve = dense_scores(spark, path, ["embedding_novelty"]).withColumnRenamed("point", "threshold")
    return rounded(scoring.stream_headroom(curve, ["stream_id"], BAR), ["best_validity", "threshold", "calls_per_min", "event_recall"])


@query("g14_diagnosis", f"""WITH {DENSE_REC}, {score_sql(False)}, {ROOM}, {SEP[SEP.index('j AS ('):]},
d AS (SELECT avg(auc) AS mean_auc, count(*) FILTER (clears) AS n_clearing, count(*) AS n_with_events FROM sep WHERE signal = 'novelty')
SELECT {r('mean_auc', 'mean_auc')}, n_clearing, n_with_events, n_unreachable, {r('headroom_x', 'headroom_x')}, CASE WHEN n_unreachable > 0 OR mean_auc < 0.65 THEN 'signal_problem' WHEN headroom_x IS NULL OR headroom_x < 1.2 THEN 'neither' ELSE 'threshold_problem' END AS verdict FROM d, room""")
def g14(spark, path):
    sep = scoring.separability(tables.trace(spark, path), 1, 0, 15, ["novelty"])  # the diagnosis asks for no other
    return rounded(scoring.diagnosis(sep, room(spark, path)), ["mean_auc", "headroom_x"])


@query("g15_agreement_ceiling", f"""WITH {TR}, tok AS (SELECT answer, {content('answer')} AS w FROM (SELECT DISTINCT answer FROM tr)), pr AS (SELECT a.answer AS a, b.answer AS b, {f1('a.w', 'b.w')} AS f1 FROM tok a, tok b),
x AS (SELECT stream_id, answer, state_id, lag(answer) {W} AS pa, lag(state_id) {W} AS ps FROM tr) SELECT stream_id, {r('avg(f1)', 'ceiling')}, count(*) AS n_pairs FROM x JOIN pr ON pr.a = pa AND pr.b = answer WHERE ps = state_id GROUP BY 1""")
def g15(spark, path):
    return scoring.agreement_ceiling(tables.trace(spark, path)).withColumn("ceiling", F.round("ceiling", 6))


PASSES = f"""pa AS (SELECT conv_id, turn // 2 AS frame_idx, text FROM conversations WHERE turn % 2 = 0), pb AS (SELECT conv_id, turn // 2 AS frame_idx, text FROM conversations WHERE turn % 2 = 1),
pp AS (SELECT conv_id, {words('pa.text')} AS wa, {words('pb.text')} AS wb, {content('pa.text')} AS ca, {content('pb.text')} AS cb FROM pa JOIN pb USING (conv_id, frame_idx)),
ps AS (SELECT conv_id, wa, {f1('ca', 'cb')} AS f1, wa = wb AS exact, CASE WHEN len(wa) < 3 THEN 1.0 WHEN list_max(list_transform(list_distinct(wa), lambda x: len(list_filter(wa, lambda y: y = x))))::DOUBLE / len(wa) > 0.5 THEN 1.0 ELSE 0.0 END AS degen FROM pp)"""


@query("g16_fidelity", f"WITH {PASSES} SELECT conv_id, count(*) AS n, {r('avg(f1)', 'content_f1_mean')}, {r('avg(CAST(exact AS INTEGER))', 'exact_match_rate')}, {r('avg(degen)', 'degenerate_rate')}, {r('avg(len(wa))', 'mean_words')} FROM ps GROUP BY 1")
def g16(spark, path):
    p = quality.paired(*passes(spark, path), ["conv_id"], "frame_idx")
    return rounded(quality.fidelity(p, ["conv_id"], with_similarity=False), ["content_f1_mean", "exact_match_rate", "degenerate_rate", "mean_words"])


@query("g16_fidelity_with_similarity")
def g16_similarity(spark, path):
    return quality.fidelity(quality.paired(*passes(spark, path), ["conv_id"], "frame_idx"), ["conv_id"])


@query("g17_noise_floor", f"WITH {PASSES} SELECT conv_id, count(*) AS n, {r('avg(f1)', 'self_content_f1')}, {r('avg(CAST(exact AS INTEGER))', 'self_exact_match')} FROM ps GROUP BY 1")
def g17(spark, path):
    p = quality.paired(*passes(spark, path), ["conv_id"], "frame_idx")
    return rounded(quality.noise_floor(p, ["conv_id"]), ["self_content_f1", "self_exact_match"])


@query("g18_choice_score", f"""WITH x AS (SELECT event_type AS task_type, chr(CAST(65 + event_id % 4 AS INTEGER)) AS answer, {SAID} AS s FROM events), y AS (SELECT task_type, answer, {LETTER} AS l FROM x)
SELECT task_type, count(*) AS n, count(*) FILTER (l = answer) AS correct, {r('count(*) FILTER (l = answer)::DOUBLE / count(*)', 'accuracy')}, count(*) FILTER (l IS NULL) AS unparsed FROM y GROUP BY ROLLUP (task_type)""")
def g18(spark, path):
    e = table(spark, path, "events").select(F.col("event_type").alias("task_type"), F.chr(65 + F.col("event_id") % 4).alias("answer"), text.option_letter(said()).alias("predicted"))
    return quality.choice_score(e).withColumn("accuracy", F.round("accuracy", 6))


@query("g18_choice_by_sample", f"""WITH x AS (SELECT event_id, user_id AS sample, event_type, chr(CAST(65 + event_id % 4 AS INTEGER)) AS answer, {SAID} AS s FROM events), y AS (SELECT sample, answer, event_type <> 'error' AS reached, {LETTER} AS l FROM x)
SELECT sample, count(*) AS n_questions, count(*) FILTER (reached) AS n_reached, count(*) FILTER (NOT reached) AS n_unreached, count(*) FILTER (reached AND l = answer) AS correct,
 {r('count(*) FILTER (reached AND l = answer)::DOUBLE / nullif(count(*) FILTER (reached), 0)', 'accuracy')} FROM y GROUP BY 1""")
def g18_samples(spark, path):
    e = table(spark, path, "events")
    q = e.select("event_id", F.col("user_id").alias("sample"), F.chr(65 + F.col("event_id") % 4).alias("answer"))
    said_ = e.filter("event_type <> 'error'").select("event_id", text.option_letter(said()).alias("predicted"))
    return quality.choice_by_sample(q, said_, "sample", "event_id").withColumn("accuracy", F.round("accuracy", 6))


ATTR = f"""{TR}, {FIRED}, {HELD}, {MOVES}, cv AS (SELECT mv.stream_id, mv.frame_idx, min(f.frame_idx) AS hit_at FROM mv LEFT JOIN f ON f.stream_id = mv.stream_id AND f.fired AND f.state_id = mv.state_id AND f.frame_idx >= mv.frame_idx GROUP BY ALL),
lt AS (SELECT h.*, (SELECT max(m.frame_idx) FROM mv m WHERE m.stream_id = h.stream_id AND m.frame_idx <= h.frame_idx) AS le FROM h),
at2 AS (SELECT lt.stream_id, lt.frame_idx, CASE WHEN lt.frame_idx < 15 THEN 'warmup' WHEN hs = state_id THEN 'valid' WHEN cv.hit_at IS NULL THEN 'missed_event' ELSE 'detection_lag' END AS cause FROM lt LEFT JOIN cv ON cv.stream_id = lt.stream_id AND cv.frame_idx = le)"""


@query("g19_failure_attribution", f"""WITH {ATTR}, c AS (SELECT stream_id, count(*) FILTER (cause = 'warmup') AS warmup, count(*) FILTER (cause = 'valid') AS valid, count(*) FILTER (cause = 'missed_event') AS missed_event, count(*) FILTER (cause = 'detection_lag') AS detection_lag FROM at2 GROUP BY ROLLUP (stream_id))
SELECT *, missed_event + detection_lag AS invalid, {r('valid::DOUBLE / nullif(valid + missed_event + detection_lag, 0)', 'validity')}, {r('100.0 * missed_event / nullif(missed_event + detection_lag, 0)', 'pct_missed')}, {r('100.0 * detection_lag / nullif(missed_event + detection_lag, 0)', 'pct_lag')} FROM c""")
def g19(spark, path):
    a = scoring.attribute(fired_trace(spark, path), 30.0, 15)
    return rounded(scoring.cause_shares(a.df, ["stream_id"]), ["validity", "pct_missed", "pct_lag"])


@query("g20_missed_events", f"""WITH {TR}, {FIRED}, {MOVES}, pk AS (SELECT stream_id, frame_idx, max(novelty) OVER (PARTITION BY stream_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) AS peak FROM tr), cv AS (SELECT mv.stream_id, mv.frame_idx, mv.state_id, mv.novelty, mv.answer, min(f.frame_idx) AS hit_at FROM mv LEFT JOIN f ON f.stream_id = mv.stream_id AND f.fired AND f.state_id = mv.state_id AND f.frame_idx >= mv.frame_idx GROUP BY ALL)
SELECT cv.stream_id, cv.frame_idx, state_id AS to_state, 'state_change: ' || answer AS kind, {r('novelty', 'novelty_at_event')}, {r('peak', 'peak_novelty_after')} FROM cv JOIN pk ON pk.stream_id = cv.stream_id AND pk.frame_idx = cv.frame_idx WHERE hit_at IS NULL""")
def g20(spark, path):
    from streamlens.operators.asof import nearest
    from streamlens.operators.signals import peak_after

    tr = scoring.with_coverage(peak_after(fired_trace(spark, path), "novelty", 60))
    moves = tr.df.filter("moved")
    rows = moves.filter("covered_at is null").select("stream_id", "frame_idx", F.col("state_id").alias("to_state"), rd(F.col("novelty"), "novelty_at_event"), rd(F.col("peak_after"), "peak_novelty_after"))
    known = moves.select("stream_id", "frame_idx", F.concat(F.lit("state_change: "), "answer").alias("what"))
    out = nearest(rows, known, ["stream_id"], "frame_idx", "frame_idx", "what", "frame_idx", within=tr)
    return out.withColumnRenamed("nearest_event", "kind")


@query("g20_false_triggers", f"WITH {TR}, {FIRED}, c AS (SELECT stream_id, frame_idx, state_id, novelty, lag(state_id) {W} AS pc FROM f WHERE fired) SELECT stream_id, frame_idx, state_id, {r('novelty', 'novelty')} FROM c WHERE pc = state_id")
def g20_false(spark, path):
    from streamlens.operators.signals import call_labels

    tr = fired_trace(spark, path)
    c = call_labels(tr.with_df(tr.df.filter("fired"))).df.filter("not justified")
    return c.select("stream_id", "frame_idx", "state_id", rd(F.col("novelty"), "novelty"))


ABL = rec(f"CASE s.pid WHEN 0 THEN {NOVELTY_COND} WHEN 1 THEN k.t - s.tl >= {GAP} AND k.motion >= s.point WHEN 2 THEN k.t - s.tl >= s.point ELSE k.t - s.tl >= {GAP} AND 0.0 >= s.point END", f"(0, 0.1), (1, 0.1), (2, {DAY}), (3, 0.1)")
ARMS = "CASE pid WHEN 0 THEN 'full_system' WHEN 1 THEN 'motion_only' WHEN 2 THEN 'timer' ELSE 'no_fast_tier' END"


@query("g21_ablation_table", f"""WITH {ABL}, {score_sql(False)}, a AS (SELECT {ARMS} AS arm, count(*) AS n_streams, avg(validity) AS v, stddev_pop(validity) AS sd, min(validity) AS mn, avg(calls_per_min) AS c, avg(event_recall) AS rc, avg(false_trigger_rate) AS ft, avg(delay) AS dl FROM sc GROUP BY pid), b AS (SELECT v AS bv, c AS bc FROM a WHERE arm = 'full_system')
SELECT arm, n_streams, {r('v', 'validity_mean')}, {r('sd', 'validity_std')}, {r('mn', 'validity_min')}, {r('c', 'calls_per_min_mean')}, {r('rc', 'event_recall_mean')}, {r('ft', 'false_trigger_rate_mean')}, {r('v - bv', 'validity_vs_full')}, {r('c / bc', 'calls_vs_full')} FROM a, b""")
def g21(spark, path):
    from streamlens.operators.sweep import sweep

    tr = tables.trace(spark, path)
    full, motion, timer = make_policy("embedding_novelty", 0.1, min_gap_s=GAP), make_policy("motion_threshold", 0.1, min_gap_s=GAP), FixedInterval(DAY)
    seeing = sweep(tr, [full, motion, timer]).withColumn("arm", F.when(F.col("kind") == "embedding_novelty", "full_system").when(F.col("kind") == "motion_threshold", "motion_only").otherwise("timer"))
    blind = sweep(tr.transform(traces.blinded), [full]).withColumn("arm", F.lit("no_fast_tier"))
    t = across_streams(seeing.unionByName(blind), ["arm"])
    d = versus(t, F.col("arm") == "full_system", [], {"calls_vs_full": "calls_per_min_mean"}, {"validity_vs_full": "validity_mean"})
    cols = ["validity_mean", "validity_std", "validity_min", "calls_per_min_mean", "event_recall_mean", "false_trigger_rate_mean", "validity_vs_full", "calls_vs_full"]
    return rounded(d.select("arm", "n_streams", *cols), cols)


@query("g22_discrimination", f"""WITH {EV}, x AS (SELECT stream_id AS encoder, CASE event_type WHEN 'click' THEN 'lighting' WHEN 'view' THEN 'motion' ELSE 'semantic' END AS kind, value / 500.0 AS d FROM ev),
m AS (SELECT encoder, median(d) FILTER (kind = 'lighting') AS l, median(d) FILTER (kind = 'motion') AS m, median(d) FILTER (kind = 'semantic') AS s FROM x GROUP BY 1)
SELECT encoder, {r('l', 'd_lighting_median')}, {r('m', 'd_motion_median')}, {r('s', 'd_semantic_median')}, {r('CASE WHEN l > 1e-9 THEN s / l END', 'discrimination')}, {r('CASE WHEN m > 1e-9 THEN s / m END', 'semantic_vs_motion')} FROM m""")
def g22(spark, path):
    kind = F.when(F.col("event_type") == "click", "lighting").when(F.col("event_type") == "view", "motion").otherwise("semantic")
    d = tables.events(spark, path).select(F.col("stream_id").alias("encoder"), kind.alias("kind"), (F.col("value") / 500.0).alias("distance"))
    out = telemetry.discrimination(d, ["encoder"])
    return rounded(out, [c for c in out.columns if c != "encoder"])


@query("g23_latency_bench", f"""WITH {EV} SELECT event_type AS label, count(*) AS n_reps, {r('quantile_cont(value, 0.5)', 'p50_ms')}, {r('quantile_cont(value, 0.95)', 'p95_ms')}, {r('quantile_cont(value, 0.99)', 'p99_ms')}, {r('avg(value)', 'mean_ms')}, {r('1000.0 / quantile_cont(value, 0.5)', 'max_fps')} FROM ev GROUP BY 1""")
def g23(spark, path):
    e = tables.events(spark, path).select(F.col("event_type").alias("label"), "value")
    b = percentile_block(e, ["label"], "value")
    return b.select("label", F.col("n").alias("n_reps"), rd(F.col("p50"), "p50_ms"), rd(F.col("p95"), "p95_ms"), rd(F.col("p99"), "p99_ms"), rd(F.col("mean"), "mean_ms"), rd(1000.0 / F.col("p50"), "max_fps"))


BENCH = f"""{EV}, bc AS (SELECT stream_id AS label, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS ttft, value / 100 AS enc, value * 3 AS total, CAST(floor(value) AS INTEGER) AS tok, value / 50 AS mem FROM ev),
bb AS (SELECT label, count(*) AS n_calls, min(ttft + enc) AS mn, avg(CASE WHEN tok > 0 AND total > 0 THEN tok / (total / 1000.0) END) AS tps, max(mem) AS mem, quantile_cont(ttft + enc, 0.5) AS t50, quantile_cont(ttft + enc, 0.95) AS t95, quantile_cont(ttft + enc, 0.99) AS t99, quantile_cont(total, 0.5) AS x50, quantile_cont(total, 0.95) AS x95 FROM bc GROUP BY 1)"""


def bench_calls(spark, path, label="stream_id", streamed=None):
    v = F.col("value")
    streamed = F.col("event_type") != "error" if streamed is None else streamed
    return tables.events(spark, path).select(F.col(label).alias("label"), F.when(streamed, v).alias("ttft_ms"), (v / 100).alias("encode_ms"), (v * 3).alias("total_ms"),
                                             F.floor(v).cast("int").alias("n_tokens"), (v / 50).alias("mem_gb"))


@query("g24_config_bench", f"WITH {BENCH} SELECT label, n_calls, {r('mn', 'ttft_min_ms')}, {r('tps', 'tokens_per_s')}, {r('mem', 'peak_mem_gb')}, {r('t50', 'ttft_p50_ms')}, {r('t95', 'ttft_p95_ms')}, {r('t99', 'ttft_p99_ms')}, {r('x50', 'total_p50_ms')}, {r('x95', 'total_p95_ms')} FROM bb")
def g24(spark, path):
    d = telemetry.config_bench(bench_calls(spark, path), ["label"])
    return rounded(d, [c for c in d.columns if c not in ("label", "n_calls")])


@query("g25_arm_bench", f"""WITH {EV}, a AS (SELECT event_type AS label, count(*) AS n_calls, quantile_cont(CASE WHEN event_type <> 'signup' THEN value + value / 100 END, 0.5) AS t50, quantile_cont(value * 3, 0.5) AS x50 FROM ev GROUP BY 1)
SELECT label, n_calls, {r('t50', 'ttft_p50_ms')}, {r('x50', 'total_p50_ms')}, {r("(SELECT t50 FROM a WHERE label = 'click') / t50", 'ttft_speedup')} FROM a""")
def g25(spark, path):
    d = telemetry.config_bench(bench_calls(spark, path, "event_type", F.col("event_type") != "signup"), ["label"])
    base = versus(d, F.col("label") == "click", [], {"_slow": "ttft_p50_ms"}, {})
    return base.select("label", "n_calls", rd(F.col("ttft_p50_ms"), "ttft_p50_ms"), rd(F.col("total_p50_ms"), "total_p50_ms"), rd(F.try_divide(F.lit(1.0), F.col("_slow")), "ttft_speedup"))


@query("g26_wall_clock_audit", f"""WITH {TR}, x AS (SELECT stream_id, frame_idx, frame_idx / 30.0::DOUBLE + CASE WHEN stream_id % 2 = 0 THEN novelty ELSE -(frame_idx / 30.0::DOUBLE) / 2 END AS a FROM tr)
SELECT stream_id, count(*) AS delivered, {r('max(a)', 'elapsed_s')}, {r('max(a) * 30.0 + 1', 'allowed')}, count(*) FILTER (a - frame_idx / 30.0::DOUBLE > 0.1) AS rows_late, {r('max((a - frame_idx / 30.0::DOUBLE) * 1000.0)', 'max_lateness_ms')}, count(*) <= max(a) * 30.0 + 1 AS within_wall_clock FROM x GROUP BY 1""")
def g26(spark, path):
    due = F.col("frame_idx") / F.lit(30.0)
    log = tables.trace(spark, path).df.select("stream_id", "frame_idx", F.lit(30.0).alias("fps"), (due + F.when(F.col("stream_id") % 2 == 0, F.col("novelty")).otherwise(-due / 2)).alias("arrived_t"))
    return rounded(telemetry.wall_clock_audit(log, ["stream_id"], 0.1), ["elapsed_s", "allowed", "max_lateness_ms"])


@query("g26_wall_clock_verdict", f"""WITH {TR}, x AS (SELECT stream_id, frame_idx, frame_idx / 30.0::DOUBLE + CASE WHEN stream_id % 2 = 0 THEN novelty ELSE -(frame_idx / 30.0::DOUBLE) / 2 END AS a FROM tr),
s AS (SELECT stream_id, count(*) AS d, count(*) FILTER (a - frame_idx / 30.0::DOUBLE > 0.1) AS l, max((a - frame_idx / 30.0::DOUBLE) * 1000.0) AS m, count(*) <= max(a) * 30.0 + 1 AS ok FROM x GROUP BY 1)
SELECT count(*) AS n_streams, {lng('sum(d)', 'delivered')}, {lng('sum(l)', 'rows_late')}, {r('max(m)', 'max_lateness_ms')}, count(*) FILTER (NOT ok) AS n_beyond, bool_and(ok) AS within_wall_clock FROM s""")
def g26_verdict(spark, path):
    due = F.col("frame_idx") / F.lit(30.0)
    log = tables.trace(spark, path).df.select("stream_id", "frame_idx", F.lit(30.0).alias("fps"), (due + F.when(F.col("stream_id") % 2 == 0, F.col("novelty")).otherwise(-due / 2)).alias("arrived_t"))
    return rounded(telemetry.wall_clock_verdict(telemetry.wall_clock_audit(log, ["stream_id"], 0.1)), ["max_lateness_ms"])


@query("g27_timeline_summary", f"WITH {QE} SELECT stream_id, count(*) AS n_queries, count(evidence_t) AS n_answered, count(*) FILTER (evidence_t IS NULL) AS n_unanswered, {r('avg(t - evidence_t)', 'staleness_s_mean', 3)}, {r('max(t - evidence_t)', 'staleness_s_max', 3)}, {lng('0', 'future_evidence_violations')} FROM ans GROUP BY 1")
def g27(spark, path):
    from streamlens.operators.asof import timeline_summary

    d = timeline_summary(answered(spark, path), ["stream_id"])
    return d.withColumns({c: F.round(c, 3) for c in ("staleness_s_mean", "staleness_s_max")})


@query("g28_budget", f"""WITH {RUNS}, e AS (SELECT stream_id AS run_id, avg(value) AS j FROM ev GROUP BY 1) SELECT run_id, {r('achieved_fps / nullif(calls_per_min / 60.0, 0)', 'deficit_x')}, {r('100.0 * captured / (captured + dropped)', 'kept_pct')}, {r('100.0 * dropped / (captured + dropped)', 'dropped_pct')},
{r('calls_per_min / 60.0 * j', 'achieved_w', 9)}, {r('achieved_fps * j', 'per_frame_w', 9)}, {r('achieved_fps * j / 95.0', 'over_cap_x', 9)} FROM rr JOIN e USING (run_id)""")
def g28(spark, path):
    j = tables.events(spark, path).groupBy(F.col("stream_id").alias("run_id")).agg(F.avg("value").alias("energy_per_query_j"))
    d = telemetry.budget(run_rates(spark, path).join(j, "run_id"), 95.0)
    return d.select("run_id", *[rd(F.col(c), c) for c in ("deficit_x", "kept_pct", "dropped_pct")], *[rd(F.col(c), c, 9) for c in ("achieved_w", "per_frame_w", "over_cap_x")])


@query("g29_backend_speedup", f"""WITH x AS (SELECT {LABELS} AS label, p_retailprice::DOUBLE AS ms FROM part), y AS (SELECT CASE WHEN label LIKE '%control%' THEN 'control' WHEN label LIKE '%onnx%' THEN 'onnx' ELSE 'torch' END AS b, replace(replace(replace(replace(label, ' (control, no network)', ''), '@224', ''), ' torch fp16', ''), ' onnx', '') AS model, ms FROM x),
z AS (SELECT model, median(ms) FILTER (b = 'torch') AS torch, median(ms) FILTER (b = 'onnx') AS onnx FROM y GROUP BY 1) SELECT model, {r('torch', 'torch')}, {r('onnx', 'onnx')}, {r('torch / onnx', 'speedup')} FROM z WHERE torch IS NOT NULL AND onnx IS NOT NULL""")
def g29(spark, path):
    from streamlens.functions.scalars import backend_of, model_of
    from streamlens.operators.quantiles import quantiles

    p = table(spark, path, "part").select(backend_label().alias("label"), F.col("p_retailprice").cast("double").alias("ms"))
    p = p.select(backend_of(F.col("label")).alias("backend"), model_of(F.col("label")).alias("model"), "ms")
    wide = quantiles(p, ["model", "backend"], "ms", [0.5]).groupBy("model").pivot("backend", ["torch", "onnx"]).agg(F.first("q_0"))
    return wide.filter("torch is not null and onnx is not null").select("model", rd(F.col("torch"), "torch"), rd(F.col("onnx"), "onnx"), rd(F.col("torch") / F.col("onnx"), "speedup"))


@query("g30_oversampling", f"""WITH {rec("k.t - s.tl >= s.point", f"(0, {DAY})")}, {MOVES}, c AS (SELECT stream_id, count(*) FILTER (fired) AS c FROM s GROUP BY 1), m AS (SELECT stream_id, count(*) AS e FROM mv GROUP BY 1), d AS (SELECT stream_id, max(t) - min(t) AS duration_s FROM tr GROUP BY 1)
SELECT stream_id, {r('duration_s', 'duration_s', 3)}, coalesce(e, 0) AS events, c AS timer_calls, {r('duration_s / e', 's_per_event', 3)}, {r('c::DOUBLE / e', 'oversampling')} FROM d JOIN c USING (stream_id) LEFT JOIN m USING (stream_id)""")
def g30(spark, path):
    tr = tables.trace(spark, path)
    d = scoring.oversampling(tr, decisions(tr, [FixedInterval(DAY)]))
    return d.withColumns({"duration_s": F.round("duration_s", 3), "s_per_event": F.round("s_per_event", 3), "oversampling": F.round("oversampling", 6)})


KINDS = ["click", "view", "purchase", "signup", "error"]


@query("g31_event_counts", f"WITH {EV} SELECT stream_id AS run_id, {', '.join(f'count(*) FILTER (event_type = {chr(39)}{k}{chr(39)}) AS {k}' for k in KINDS)}, count(*) > 66 AS truncated FROM ev GROUP BY 1")
def g31(spark, path):
    e = tables.events(spark, path).withColumnRenamed("stream_id", "run_id")
    return telemetry.event_counts(e, ["run_id"], "event_type", KINDS, 66)


@query("g32_clip_inventory", f"""WITH {TR}, {MOVES}, a AS (SELECT stream_id, count(*) AS n, count(DISTINCT state_id) AS s FROM tr GROUP BY 1), b AS (SELECT stream_id, count(*) AS e, count(*) FILTER (motion >= 0.1) AS sem FROM mv GROUP BY 1)
SELECT stream_id, n AS n_frames, coalesce(e, 0) AS n_events, coalesce(sem, 0) AS n_semantic, s AS n_states FROM a LEFT JOIN b USING (stream_id)""")
def g32(spark, path):
    return annotations.inventory(annotation_docs(spark, path)).withColumn("stream_id", F.col("stream_id").cast("long"))


TICK = "CAST(floor(t / 86400) AS BIGINT)"


@query("g33_backlog_statistics", f"""WITH {EV}, x AS (SELECT stream_id AS queue, event_id, t_us, {TICK} AS tick, CAST(floor(value / 10) AS INTEGER) AS depth, row_number() OVER (PARTITION BY stream_id, {TICK} ORDER BY t_us DESC, event_id DESC) AS rn FROM ev)
SELECT queue, count(*) FILTER (rn <= 2) AS n_put, count(*) FILTER (rn > 2) AS n_dropped, max(depth) AS peak_depth, arg_max(depth, t_us) AS final_depth FROM x GROUP BY 1""")
def g33(spark, path):
    e = tables.events(spark, path).select(F.col("stream_id").alias("queue"), "event_id", "t_us", F.floor(F.col("t") / 86400).cast("long").alias("tick"), F.floor(F.col("value") / 10).cast("int").alias("depth"))
    return backlog_stats(thin(e, ["queue", "tick"], ["t_us", "event_id"], 2), ["queue"], "depth", "t_us")
