"""Cutting large keys must not change an answer: every ordered operator, whole and in chunks of a few rows, on a table with a
NULL key, a far-off time, bursts of tied times and nulls among the values."""

import random

import pytest
from oracle import rows_of
from pyspark.sql import functions as F

from streamlens.operators import asof, choose, quantiles, scoring, signals, triggers
from streamlens.operators.fold import fold
from streamlens.operators.layout import CHUNK, lay_out
from streamlens.operators.policies import AdaptiveQuantile, FixedInterval, InformationGain, SignalThreshold, Trigger
from streamlens.operators.sweep import sweep

DDL = "stream_id string, frame_idx long, t double, motion double, novelty double, scene_change double, state_id long, answer string"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(11)
    rows = []
    for key, n in ((None, 90), ("hot", 140), ("small", 5), ("one", 1)):
        t = 0.0
        for i in range(n):
            t += rng.choice([0.0, 0.0, 0.05, 0.4]) if i else 0.0  # tied times, bursts
            if key == "hot" and i == n - 1:
                t = 1e9  # far off
            state = (i // 17) % 3
            rows.append((key, i, t, rng.random(), rng.random(), rng.random(), state, rng.choice([None, "a desk", "a red mug", f"state {state} here"])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DDL).repartition(5).cache()


def trace(odd):
    return lay_out(odd, ["stream_id"], ["t", "frame_idx"])


POLICIES = [FixedInterval(0.3), FixedInterval(0.0), SignalThreshold("embedding_novelty", "novelty", 0.6, 0.2), InformationGain(0.1, 3.0, 0.2),
            AdaptiveQuantile(0.8, 5.0, 0.2, 10)]


def with_fired(odd):
    return trace(odd).transform(lambda d: d.withColumn("fired", F.col("novelty") > 0.7))


CASES = {
    "lag": lambda o: trace(o).lag(p="novelty", q="answer").result(),
    "last": lambda o: trace(o).last(a="answer").result(),
    "running": lambda o: trace(o).running(s=F.lit(1).cast("long"), n=F.when(F.col("novelty") > 0.5, 1)).result(),
    "row_number": lambda o: trace(o).row_number("rn").result(),
    "next_value": lambda o: signals.next_value(trace(o), F.when(F.col("novelty") > 0.8, F.col("frame_idx")), "nx").result(),
    "peak_after": lambda o: signals.peak_after(trace(o), "novelty", 7).result(),
    "first_value": lambda o: signals.first_value(trace(o), "novelty", "f0").result(),
    "relative_time": lambda o: signals.relative_time(trace(o), "t").result(),
    "transitions": lambda o: signals.transitions(trace(o)).result().drop(CHUNK),
    "scene_states": lambda o: signals.scene_states(trace(o)),
    "event_masks": lambda o: signals.event_masks(trace(o), 3, 2, 5).result(),
    "quantiles": lambda o: quantiles.quantiles(o, ["stream_id"], "novelty", [0.1, 0.5, 0.95]),
    "percentile_block": lambda o: quantiles.percentile_block(o, ["stream_id"], "motion"),
    "auc": lambda o: quantiles.auc(o.withColumn("y", F.col("state_id") == 1), ["stream_id"], "novelty", "y"),
    "quantiles_where": lambda o: quantiles.quantiles_where(o, ["stream_id"], "novelty", {"a": (F.col("state_id") == 1, 0.5), "b": (F.col("state_id") == 2, 0.9)}),
    "triggers": lambda o: fold(trace(o), Trigger(POLICIES)),
    "score": lambda o: scoring.score(with_fired(o)),
    "sweep": lambda o: sweep(trace(o), POLICIES, with_text=True),
    "separability": lambda o: scoring.separability(trace(o), 3, 2, 0),
    "asof": lambda o: asof.asof(o.where("novelty < 0.3"), o.where("novelty >= 0.3").selectExpr("stream_id", "t", "frame_idx", "motion AS m"), ["stream_id"], ["m"], q_tie="frame_idx", e_tie="frame_idx"),
    "thin": lambda o: choose.thin(o, ["stream_id"], ["t", "frame_idx"], 3, True),
    "strided": lambda o: choose.strided(o, ["stream_id"], ["t", "frame_idx"], 4),
    "calls_per_minute": lambda o: triggers.calls_per_minute(trace(o), o.where("novelty > 0.7")),
}


def rounded(df):
    return df.select(*[F.round(c, 7).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@pytest.mark.parametrize("name", sorted(CASES))
def test_split_equals_whole(odd, chunks, name):
    out = []
    for size in (4_000_000, 13):
        chunks(size)
        df = rounded(CASES[name](odd).drop(CHUNK))
        out.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    assert out[0] == out[1] and out[0]
    if "stream_id" in CASES[name](odd).columns:
        df = CASES[name](odd)
        assert df.where("stream_id is null").limit(1).count() == 1  # the NULL key is a key like any other


def test_chunks_are_even_whatever_the_times(odd, chunks):
    """A far-off time and tied times leave no chunk much over the target, and chunks follow the order."""
    chunks(20)
    laid = trace(odd)
    sizes = laid.df.where("_chunk >= 0").groupBy("stream_id", CHUNK).agg(F.count("*").alias("n"), F.min(F.struct("t", "frame_idx")).alias("lo"), F.max(F.struct("t", "frame_idx")).alias("hi")).collect()
    assert len(sizes) >= 8 and max(r.n for r in sizes) <= 60
    for key in (None, "hot"):
        mine = sorted((r for r in sizes if r.stream_id == key), key=lambda r: r._chunk)
        assert all(a.hi < b.lo for a, b in zip(mine, mine[1:]))
    assert {r.stream_id for r in laid.df.where("_chunk < 0").select("stream_id").distinct().collect()} == {"small", "one"}


def test_no_row_carries_the_borders(odd, chunks):
    """What a row brings along does not grow with the number of chunks of its key."""
    chunks(5)
    laid = trace(odd)
    assert laid.df.where("_chunk >= 0").select("stream_id", CHUNK).distinct().count() > 30
    assert set(laid.df.columns) == {*odd.columns, CHUNK}
    assert "borders" not in laid.df._jdf.queryExecution().toString()
