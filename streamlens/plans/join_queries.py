"""Joins: as-of, audits, coverage, nearest, semi, anti and baseline joins."""

from pyspark.sql import functions as F

from streamlens.operators import asof, telemetry
from streamlens.operators.policies import make_policy
from streamlens.operators.scoring import rank_first, versus
from streamlens.operators.signals import transitions
from streamlens.operators.triggers import decisions
from streamlens.plans.registry import EV, TR, query, r
from streamlens.plans.scalar import rd
from streamlens.plans.signal_queries import FIRED, MOVES, fired_trace
from streamlens.plans.trigger_queries import GAP, NOVELTY_COND, rec
from streamlens.sources import tables, traces
from streamlens.sources.tables import table

QE = f"""{EV}, q AS (SELECT stream_id, event_id AS query_id, t FROM ev WHERE event_type = 'view'), e AS (SELECT stream_id, event_id AS evidence_id, t AS evidence_t FROM ev WHERE event_type = 'purchase'),
ans AS (SELECT q.stream_id, q.query_id, q.t, e.evidence_id, e.evidence_t FROM q ASOF LEFT JOIN e ON q.stream_id = e.stream_id AND q.t >= e.evidence_t)"""


def query_evidence(spark, path):
    laid = tables.events_laid(spark, path)
    ev = laid.df
    q = ev.filter("event_type = 'view'").select("stream_id", F.col("event_id").alias("query_id"), "t")
    e = ev.filter("event_type = 'purchase'").select("stream_id", F.col("event_id").alias("evidence_id"), "t")
    return q, e, laid


def answered(spark, path):
    q, e, laid = query_evidence(spark, path)
    return asof.asof(q, e, ["stream_id"], ["evidence_id"], q_tie="query_id", e_tie="evidence_id", within=laid)


@query("f1_asof_backward", f"WITH {QE} SELECT stream_id, query_id, {r('t', 't')}, evidence_id, {r('evidence_t', 'evidence_t')}, {r('t - evidence_t', 'staleness_s', 4)} FROM ans")
def f1(spark, path):
    a = answered(spark, path)
    return a.select("stream_id", "query_id", rd(F.col("t"), "t"), "evidence_id", rd(F.col("evidence_t"), "evidence_t"), rd(F.col("t") - F.col("evidence_t"), "staleness_s", 4))


# A forged answer log: evidence moved value/100 days later, so that some of it lies in the future.
@query("f2_future_evidence", f"WITH {QE}, f AS (SELECT stream_id, query_id, t, evidence_t + (query_id % 5) * 43200.0 AS et FROM ans) SELECT stream_id, query_id, {r('et - t', 'ahead_s', 4)} FROM f WHERE et > t + 1e-9")
def f2(spark, path):
    forged = answered(spark, path).withColumn("evidence_t", F.col("evidence_t") + (F.col("query_id") % 5) * 43200.0)
    return asof.future_evidence(forged).select("stream_id", "query_id", rd(F.col("ahead_s"), "ahead_s", 4))


NOW = 1704067200.0 + 15 * 86400  # mid-month


@query("f3_due_unanswered", f"WITH {QE} SELECT stream_id, query_id FROM q WHERE t <= {NOW} AND query_id NOT IN (SELECT query_id FROM ans WHERE evidence_t IS NOT NULL)")
def f3(spark, path):
    q, _, _ = query_evidence(spark, path)
    done = answered(spark, path).filter("evidence_t is not null")
    return asof.due(q, done, F.lit(NOW)).select("stream_id", "query_id")


CALLS = f"""{EV}, cl AS (SELECT stream_id AS run_id, 'c' || event_id AS call_id, CASE WHEN event_id % 97 = 0 THEN event_id + 1000000000 ELSE event_id END AS frame_id, t + value / 1000.0 AS t1, t + value * 3.0 / 1000.0 AS t2 FROM ev WHERE event_type = 'click'),
lat AS (SELECT cl.run_id, call_id, frame_id, (t1 - ev.t) * 1000.0::DOUBLE AS first_token_ms, (t2 - ev.t) * 1000.0::DOUBLE AS answer_ms FROM cl JOIN ev ON ev.stream_id = cl.run_id AND ev.event_id = cl.frame_id)"""


@query("f4_call_latency", f"WITH {CALLS} SELECT run_id, call_id, {r('first_token_ms', 'first_token_ms', 2)}, {r('answer_ms', 'answer_ms', 2)} FROM lat")
def f4(spark, path):
    fr, calls, _ = tables.call_log(spark, path)
    d = telemetry.call_latencies(calls, fr, ["run_id"])
    return d.select("run_id", "call_id", rd(F.col("first_token_ms"), "first_token_ms", 2), rd(F.col("answer_ms"), "answer_ms", 2))


@query("f5_answer_staleness", f"WITH {EV} SELECT stream_id AS run_id, 'a' || event_id AS answer_id, {r('((t + value * 3.0 / 1000.0) - t) * 1000.0', 'staleness_ms', 2)} FROM ev WHERE event_type = 'click'")
def f5(spark, path):
    fr, _, answers = tables.call_log(spark, path)
    return telemetry.answer_staleness(answers, fr, ["run_id"]).withColumn("staleness_ms", F.round("staleness_ms", 2))


@query("f6_oracle_lookup", f"WITH {rec(NOVELTY_COND, '(0, 0.1)')} SELECT s.stream_id, s.f AS frame_idx, tr.answer, tr.state_id FROM s JOIN tr ON tr.stream_id = s.stream_id AND tr.frame_idx = s.f WHERE fired")
def f6(spark, path):
    tr = tables.trace(spark, path)
    d = decisions(tr, [make_policy("embedding_novelty", 0.1, min_gap_s=GAP)]).select("stream_id", "frame_idx")
    return d.join(tr.df.select("stream_id", "frame_idx", "answer", "state_id"), ["stream_id", "frame_idx"])


@query("f7_coverage", f"""WITH {TR}, {FIRED}, {MOVES} SELECT mv.stream_id, mv.state_id, mv.frame_idx AS event_frame, min(f.frame_idx) AS covered_at FROM mv LEFT JOIN f ON f.stream_id = mv.stream_id AND f.fired AND f.state_id = mv.state_id AND f.frame_idx >= mv.frame_idx GROUP BY ALL""")
def f7(spark, path):
    tr = fired_trace(spark, path)
    return asof.coverage(transitions(tr).df, tr.df.filter("fired"), ["stream_id"], within=tr)


@query("f8_nearest_event", f"""WITH {EV}, x AS (SELECT a.stream_id, a.event_id, min(struct_pack(d := abs(a.t_us - b.t_us), e := b.t_us, k := b.event_id)) AS m FROM ev a JOIN ev b ON a.stream_id = b.stream_id AND b.event_type = 'error' WHERE a.event_type = 'purchase' GROUP BY ALL)
SELECT a.stream_id, a.event_id, coalesce('error: ' || m.k, 'unknown') AS nearest_event FROM ev a LEFT JOIN x ON a.event_id = x.event_id WHERE a.event_type = 'purchase'""")
def f8(spark, path):
    laid = tables.events_laid(spark, path)
    rows = laid.df.filter("event_type = 'purchase'").select("stream_id", "event_id", "t_us")
    ev = laid.df.filter("event_type = 'error'").select("stream_id", "t_us", F.concat(F.lit("error: "), F.col("event_id")).alias("what"))
    return asof.nearest(rows, ev, ["stream_id"], "t_us", "t_us", "what", "event_id", within=laid).select("stream_id", "event_id", "nearest_event")


RANK = "CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END"


@query("f9_reference_row", f"""WITH x AS (SELECT p_partkey, p_brand, {RANK} AS rk, p_retailprice::DOUBLE AS v FROM part), ref AS (SELECT p_brand, arg_min(p_partkey, struct_pack(rk := rk, k := p_partkey)) AS ref_key FROM x GROUP BY 1)
SELECT x.p_partkey, ref.ref_key AS reference, {r('x.v - y.v', 'delta')} FROM x JOIN ref USING (p_brand) JOIN x y ON y.p_partkey = ref.ref_key""")
def f9(spark, path):
    p = table(spark, path, "part").select("p_partkey", "p_brand", (F.col("p_size") % 4).alias("rk"), F.col("p_retailprice").cast("double").alias("v"))
    ref = rank_first(p, ["p_brand"], ["rk", "p_partkey"]).select("p_brand", F.col("p_partkey").alias("reference"), F.col("v").alias("rv"))
    return p.join(ref, "p_brand").select("p_partkey", "reference", rd(F.col("v") - F.col("rv"), "delta"))


@query("f10_paired_passes", """WITH a AS (SELECT conv_id, turn // 2 AS frame_idx, text FROM conversations WHERE turn % 2 = 0), b AS (SELECT conv_id, turn // 2 AS frame_idx, text FROM conversations WHERE turn % 2 = 1)
SELECT a.conv_id, a.frame_idx, md5(a.text) AS a, md5(b.text) AS b FROM a JOIN b USING (conv_id, frame_idx)""")
def f10(spark, path):
    from streamlens.operators.quality import paired

    first, second = passes(spark, path)
    return paired(first, second, ["conv_id"], "frame_idx").select("conv_id", "frame_idx", F.md5("a").alias("a"), F.md5("b").alias("b"))


def passes(spark, path):
    """Even turns as the first pass over the frames, odd turns as the second."""
    c = table(spark, path, "conversations").withColumn("frame_idx", F.floor(F.col("turn") / 2).cast("long"))
    return c.filter("turn % 2 = 0"), c.filter("turn % 2 = 1")


@query("f11_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def f11_semi(spark, path):
    flagged = table(spark, path, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, path, "orders").select("o_orderkey").join(flagged, "o_orderkey", "left_semi")


@query("f11_anti_join", f"WITH {EV} SELECT DISTINCT stream_id FROM ev WHERE stream_id NOT IN (SELECT stream_id FROM ev WHERE value > 400)")
def f11_anti(spark, path):
    e = tables.events(spark, path)
    return e.select("stream_id").distinct().join(e.filter("value > 400").select("stream_id"), "stream_id", "left_anti")


@query("f12_policy_grid", f"""WITH {TR}, g AS (SELECT unnest([0.05, 0.1, 0.2, 0.3])::DOUBLE AS point) SELECT stream_id, point, count(*) FILTER (novelty >= point) AS candidates, count(*) AS n_rows FROM tr, g GROUP BY ALL""")
def f12(spark, path):
    # Each row meets the four settings inside the aggregate, so the trace is never multiplied.
    pts = [0.05, 0.1, 0.2, 0.3]
    tr = tables.trace(spark, path).df.groupBy("stream_id").agg(
        F.count("*").alias("n_rows"), F.array(*[F.struct(F.lit(p).alias("point"), F.count_if(F.col("novelty") >= p).alias("candidates")) for p in pts]).alias("g"))
    return tr.select("stream_id", F.inline("g"), "n_rows")


@query("f13_baseline_row", f"""WITH {EV}, a AS (SELECT stream_id, event_type, avg(value) AS v, count(*)::DOUBLE AS n FROM ev GROUP BY ALL), b AS (SELECT stream_id, v AS bv, n AS bn FROM a WHERE event_type = 'click')
SELECT a.stream_id, event_type, {r('CASE WHEN bv <> 0 THEN v / bv END', 'value_ratio')}, {r('n - bn', 'count_delta')} FROM a LEFT JOIN b USING (stream_id)""")
def f13(spark, path):
    a = tables.events(spark, path).groupBy("stream_id", "event_type").agg(F.avg("value").alias("v"), F.count("*").cast("double").alias("n"))
    d = versus(a, F.col("event_type") == "click", ["stream_id"], {"value_ratio": "v"}, {"count_delta": "n"})
    return d.select("stream_id", "event_type", rd(F.col("value_ratio"), "value_ratio"), rd(F.col("count_delta"), "count_delta"))


@query("f14_old_vs_new_signal", f"""WITH {TR}, x AS (SELECT stream_id, novelty AS old, sqrt(novelty) AS new FROM tr) SELECT stream_id, {r('quantile_cont(old, 0.95)', 'old_p95')}, {r('quantile_cont(new, 0.95)', 'new_p95')}, {r('max(abs(new - old))', 'max_change')} FROM x GROUP BY 1""")
def f14(spark, path):
    from streamlens.operators.quantiles import quantiles

    tr = tables.trace(spark, path)
    new = tr.df.select("stream_id", "frame_idx", F.sqrt("novelty").alias("novelty_new"))
    both = traces.backfill(tr.df, new, ["novelty_new"])
    q_old = quantiles(both, ["stream_id"], "novelty", [0.95], within=tr).withColumnRenamed("q_0", "old_p95")
    q_new = quantiles(both, ["stream_id"], "novelty_new", [0.95], within=tr).withColumnRenamed("q_0", "new_p95")
    ch = both.groupBy("stream_id").agg(F.max(F.abs(F.col("novelty_new") - F.col("novelty"))).alias("max_change"))
    return q_old.join(q_new, "stream_id").join(ch, "stream_id").select("stream_id", *[rd(F.col(c), c) for c in ("old_p95", "new_p95", "max_change")])


@query("k1_query_schedule", f"""WITH {TR}, d AS (SELECT stream_id, count(*) / 30.0::DOUBLE AS duration_s FROM tr GROUP BY 1), g AS (SELECT stream_id, duration_s, unnest(range(1, CAST(ceil(duration_s / 0.25) AS BIGINT) + 1)) AS i FROM d)
SELECT stream_id, 'q' || (i - 1) AS query_id, {r('i * 0.25', 't')} FROM g WHERE i * 0.25 < duration_s - 1e-6""")
def k1(spark, path):
    d = tables.trace(spark, path).df.groupBy("stream_id").agg((F.count("*") / F.lit(30.0)).alias("duration_s"))
    return asof.query_schedule(d, ["stream_id"], 0.25).withColumn("t", F.round("t", 6))


@query("k2_threshold_grid", f"""WITH {TR}, g AS (SELECT unnest(range(0, 40)) AS i), c AS (SELECT stream_id, min(novelty) AS lo, max(novelty) AS hi FROM tr GROUP BY 1) SELECT stream_id, i AS i, {r('lo + (hi - lo) * i / 39', 'threshold', 5)} FROM c, g""")
def k2(spark, path):
    c = tables.trace(spark, path).df.groupBy("stream_id").agg(F.min("novelty").alias("lo"), F.max("novelty").alias("hi"))
    g = c.select("stream_id", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("i"))
    return g.select("stream_id", "i", rd(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / 39, "threshold", 5))
