import pytest
from helpers import trace, two_state_rows
from pyspark.sql import functions as F

from streamlens.functions import text
from streamlens.operators import asof, choose, quality, telemetry
from streamlens.operators.layout import lay_out
from streamlens.operators.quantiles import auc, percentile_block, quantiles

Q = "stream_id string, query_id string, t double"
E = "stream_id string, frame_idx long, t double, answer string"


def ask(spark, queries, evidence):
    q, e = spark.createDataFrame(queries, Q), spark.createDataFrame(evidence, E)
    return asof.asof(q, e, ["stream_id"], ["frame_idx", "answer"], q_tie="query_id", e_tie="frame_idx")


def test_query_between_two_frames_takes_the_earlier(spark):
    a = ask(spark, [("s", "q", 20.0)], [("s", 1, 19.987, "x"), ("s", 2, 20.020, "y")]).first()
    assert (a.answer, round(a.t - a.evidence_t, 3)) == ("x", 0.013)


def test_evidence_at_the_query_time_counts_and_none_is_null(spark):
    d = {r.query_id: r for r in ask(spark, [("s", "now", 2.0), ("s", "early", 1.0)], [("s", 7, 2.0, "x")]).collect()}
    assert d["now"].frame_idx == 7 and d["early"].evidence_t is None


def test_future_evidence_is_found_and_strict_fails(spark):
    forged = spark.createDataFrame([("s", "q", 1.0, 2.0), ("s", "r", 3.0, 2.0)], "stream_id string, query_id string, t double, evidence_t double")
    assert [r.query_id for r in asof.future_evidence(forged).collect()] == ["q"]
    with pytest.raises(Exception, match="future"):
        asof.future_evidence(forged, strict=True).collect()


def test_schedule_is_strictly_inside(spark):
    d = spark.createDataFrame([("a", 7.0), ("b", 6.0), ("c", 1.0)], "stream_id string, duration_s double")
    got = {}
    for r in asof.query_schedule(d, ["stream_id"], 2.0).collect():
        got.setdefault(r.stream_id, []).append(r.t)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [2.0, 4.0, 6.0], "b": [2.0, 4.0]}


def test_answered_query_is_not_due_again(spark):
    q = spark.createDataFrame([("s", "q0", 1.0), ("s", "q1", 2.0), ("s", "q2", 9.0)], Q)
    done = q.filter("query_id = 'q0'")
    assert [r.query_id for r in asof.due(q, done, F.lit(5.0)).collect()] == ["q1"]


def test_coverage_of_the_two_state_trace(spark):
    laid = trace(spark, two_state_rows())
    tr = laid.df.filter("frame_idx = 150")
    calls = laid.df.filter("frame_idx in (10, 160, 200)")
    assert asof.coverage(tr, calls, ["stream_id"]).first().covered_at == 160


@pytest.mark.parametrize("size", [4_000_000, 20])
def test_percentiles_of_1_to_100(spark, chunks, size):
    chunks(size)
    df = spark.range(1, 101).select(F.lit("r").alias("k"), F.col("id").cast("double").alias("v"))
    b = percentile_block(df, ["k"], "v").first()
    assert (b.n, b.p50, round(b.p95, 6), round(b.p99, 6), b.min, b.max) == (100, 50.5, 95.05, 99.01, 1.0, 100.0)
    assert quantiles(df, [], "v", [0.25]).first().q_0 == 25.75
    assert percentile_block(df.filter("v < 0"), ["k"], "v").count() == 0


def test_auc_with_ties_and_empty_class(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (0.0, False)], "v double, p boolean")
    assert auc(df, [], "v", "p").first().auc == pytest.approx(0.875)
    assert auc(df.filter("p"), [], "v", "p").first().auc is None


def test_latency_and_staleness(spark):
    frames = spark.createDataFrame([("r", 1, 100.0), ("r", 2, 50.0)], "run_id string, frame_id long, t double")
    calls = spark.createDataFrame([("r", "c", 1, 100.4, 100.9), ("r", "lost", 999, 1.0, 2.0)],
                                  "run_id string, call_id string, frame_id long, t_first_token double, t_complete double")
    r = telemetry.call_latencies(calls, frames, ["run_id"]).collect()
    assert [(round(x.first_token_ms), round(x.answer_ms)) for x in r] == [(400, 900)]
    ans = spark.createDataFrame([("r", "a", 2, 52.5)], "run_id string, answer_id string, evidence_frame_id long, t double")
    assert telemetry.answer_staleness(ans, frames, ["run_id"]).first().staleness_ms == 2500.0


def test_false_trigger_rate_needs_labels(spark):
    rows = [("r", True, True), ("r", True, False), ("r", True, False), ("r", True, None), ("r", False, False), ("n", True, None)]
    d = {x.run_id: x for x in telemetry.false_trigger_rate(spark.createDataFrame(rows, "run_id string, fired boolean, semantic_change boolean"), ["run_id"]).collect()}
    assert (round(d["r"].rate, 4), d["r"].n_labelled, d["r"].n_unlabelled) == (0.6667, 3, 1)
    assert d["n"].rate is None


@pytest.mark.parametrize("size", [4_000_000, 1])
def test_trapezoid_energy(spark, chunks, size):
    chunks(size)
    rows = [("flat", float(t), 100.0, 0, 1, 1) for t in (0, 1, 2)] + [("ramp", 0.0, 0.0, 0, 1, 1), ("ramp", 2.0, 100.0, 0, 1, 1), ("one", 0.0, 5.0, 0, 1, 1)]
    df = spark.createDataFrame(rows, "run_id string, t double, power_w double, mem_used_b long, util_gpu_pct int, temp_c int")
    d = {r.run_id: r for r in telemetry.energy(lay_out(df, ["run_id"], ["t"]), F.lit(40.0)).collect()}
    assert d["flat"].energy_j == 200.0 and d["ramp"].energy_j == 100.0 and d["flat"].energy_marginal_j == 120.0
    assert d["one"].energy_j is None and d["one"].mean_w is None


def test_wall_clock_audit_catches_a_batch_reader(spark):
    log = spark.range(60).select(F.lit("s").alias("stream_id"), F.col("id").alias("frame_idx"), F.lit(30.0).alias("fps"), F.lit(0.01).alias("arrived_t"))
    assert telemetry.wall_clock_audit(log, ["stream_id"], 0.1).first().within_wall_clock is False


def test_thinning_records_every_drop(spark):
    df = spark.range(2000).select(F.lit("k").alias("key"), F.lit(0).alias("tick"), F.col("id").alias("frame_id"))
    d = choose.thin(df, ["key", "tick"], ["frame_id"], 2)
    assert sorted(r.frame_id for r in d.filter("kept").collect()) == [1998, 1999]
    assert d.filter("reason = 'queue_full_drop_oldest'").count() == 1998
    first = choose.thin(df, ["key", "tick"], ["frame_id"], 2, newest=False).filter("kept").collect()
    assert sorted(r.frame_id for r in first) == [0, 1]


def test_text_scores(spark):
    rows = [(0, "a red mug on the desk", "a red mug on the desk"), (1, "a red mug sits on the wooden desk", "the red mug is sitting on a wooden desk"),
            (2, "a red mug", "two people walking outside"), (3, "the image shows a dog", "the image shows a car"), (4, "", ""), (5, "word", "")]
    d = {r.i: r.f for r in spark.createDataFrame(rows, "i int, a string, b string").select("i", text.content_words(F.col("a")).alias("a"), text.content_words(F.col("b")).alias("b")).select("i", text.bag_f1(F.col("a"), F.col("b")).alias("f")).collect()}
    assert d[0] == 1.0 and d[1] > 0.7 and d[2] < 0.2 and d[3] < 0.3 and d[4] == 1.0 and d[5] == 0.0
    bad = spark.createDataFrame([("",), ("the",), ("a a a a a a a a",), ("a quiet empty room",), (None,)], "x string").select(text.is_degenerate(text.words(F.col("x"))).alias("d"))
    assert [r.d for r in bad.collect()] == [True, True, True, False, True]


def test_letters_and_times(spark):
    rows = [("B.", "B"), ("(C)", "C"), ("The answer is D", "D"), ("A dog", "A"), ("b", None), ("", None), (None, None)]
    d = spark.createDataFrame(rows, "s string, want string").select(text.option_letter(F.col("s")).alias("g"), "want").collect()
    assert all(r.g == r.want for r in d)
    t = spark.createDataFrame([("01:02:03",), ("02:03",), (" 00:05 ",)], "s string").select(text.clock_seconds(F.col("s")).alias("t")).collect()
    assert [r.t for r in t] == [3723.0, 123.0, 5.0]


def test_self_consistency(spark):
    p = spark.createDataFrame([("k", 0, "a", "a"), ("k", 1, "b", "c")], "k string, frame_idx int, a string, b string")
    assert quality.noise_floor(p, ["k"]).first().self_exact_match == 0.5


def test_budget_subset_is_a_prefix(spark, chunks):
    chunks(2)
    s = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 2.0), (4, 9.0)], "sample long, last_t double")
    assert sorted(r["sample"] for r in choose.budget_subset(s, "sample", "last_t", 8.0).collect()) == [1, 2, 3]
