import numpy as np
import pytest
from helpers import random_rows, trace
from pyspark.sql import functions as F

from streamlens.operators import signals
from streamlens.operators.layout import lay_out


def embed_frames(spark, rows):
    return lay_out(spark.createDataFrame(rows, "stream_id string, frame_idx long, t double, embedding array<double>"), ["stream_id"], ["frame_idx"])


def novelty(spark, rows, **kw):
    d = signals.reference_novelty(embed_frames(spark, rows), **kw).orderBy("stream_id", "frame_idx").collect()
    return [r.novelty for r in d]


def test_not_ready_is_zero_and_equal_rows_are_zero(spark):
    rows = [("a", i, i / 30, [1.0, 0.0]) for i in range(3)]
    assert novelty(spark, rows) == [0.0, 0.0, 0.0]
    assert max(novelty(spark, [("a", i, i / 30, [0.6, 0.8]) for i in range(30)], half_life=0.5)) < 1e-9


def test_half_life_is_in_seconds(spark):
    last = []
    for fps in (15, 60):
        rows = [("a", 0, 0.0, [1.0, 0.0])] + [("a", i, i / fps, [0.0, 1.0]) for i in range(1, 2 * fps + 1)]
        last.append(novelty(spark, rows, half_life=1.0, min_updates=1)[-1])
    assert abs(last[0] - last[1]) < 0.02


def test_slow_drift_accumulates(spark):
    rows = [("a", i, i / 30, [float(np.cos(0.02 * i)), float(np.sin(0.02 * i))]) for i in range(60)]
    change = signals.scene_change(embed_frames(spark, rows)).df.agg(F.max("scene_change")).first()[0]
    assert change < 1e-3 < novelty(spark, rows)[-1]


@pytest.mark.parametrize("cells", [False, True])
def test_split_stream_equals_whole(spark, chunks, cells):
    """One reference handed from chunk to chunk gives the sequential result."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(400, 4, 8)).cumsum(axis=0) + 20
    unit = base / np.linalg.norm(base, axis=-1, keepdims=True)
    rows = [("a", i, i / 30, (unit[i].tolist() if cells else unit[i, 0].tolist())) for i in range(400)]
    ddl = "stream_id string, frame_idx long, t double, x " + ("array<array<double>>" if cells else "array<double>")
    got = []
    for size in (1_000_000, 60):
        chunks(size)
        laid = lay_out(spark.createDataFrame(rows, ddl), ["stream_id"], ["frame_idx"])
        assert laid.split == (size == 60)
        d = signals.reference_novelty(laid, column="x", cells=cells, half_life=0.5).orderBy("frame_idx").toPandas()
        got.append(d["novelty"].to_numpy())
    assert len(got[1]) == 400
    np.testing.assert_allclose(got[0], got[1], atol=1e-9)


def test_local_change_survives_pooling(spark):
    rng = np.random.default_rng(1)
    cells = rng.normal(size=(49, 8))
    cells /= np.linalg.norm(cells, axis=1, keepdims=True)
    one = cells.copy()
    one[5] *= -1
    rows = [("a", i, i / 30, (one if i == 20 else cells).tolist()) for i in range(21)]
    laid = lay_out(spark.createDataFrame(rows, "stream_id string, frame_idx long, t double, cells array<array<double>>"), ["stream_id"], ["frame_idx"])
    patch = signals.reference_novelty(laid, column="cells", cells=True, top_k=3).filter("frame_idx = 20").first().novelty
    pooled = lambda x: x.mean(0) / np.linalg.norm(x.mean(0))
    assert patch > 5 * (1 - pooled(cells) @ pooled(one))


@pytest.mark.parametrize("size", [4_000_000, 50])
def test_ordered_columns_equal_pandas(spark, chunks, size):
    chunks(size)
    rows = random_rows("a", 300, 1) + random_rows("b", 40, 2)
    laid = trace(spark, rows)
    assert laid.split == (size == 50)
    laid = laid.lag(p="novelty").running(s="novelty").row_number("rn").last(q=F.when(F.col("motion") > 0.9, F.col("novelty")))
    laid = signals.peak_after(laid, "novelty", 60)
    got = laid.result().toPandas().sort_values(["stream_id", "frame_idx"]).reset_index(drop=True)
    for _, g in got.groupby("stream_id"):
        np.testing.assert_allclose(g["p"], g["novelty"].shift())
        np.testing.assert_allclose(g["s"], g["novelty"].cumsum())
        assert list(g["rn"]) == list(range(len(g)))
        np.testing.assert_allclose(g["q"], g["novelty"].where(g["motion"] > 0.9).ffill())
        np.testing.assert_allclose(g["peak_after"], g["novelty"][::-1].rolling(60, min_periods=1).max()[::-1])


def test_one_stream_with_a_third_of_the_rows_is_spread(spark, chunks):
    chunks(200)
    rows = [r for k in range(40) for r in random_rows(f"s{k}", 50, k)] + random_rows("hot", 1000, 99)
    laid = trace(spark, rows)
    sizes = laid.df.groupBy("stream_id", "_chunk").count().toPandas()
    assert sizes["count"].max() <= 260
    assert set(sizes[sizes.stream_id != "hot"]["_chunk"]) == {-1}


def test_running_quantile_equals_an_expanding_window():
    import numpy as np
    import pandas as pd

    from streamlens.operators.signals import RunningQuantile

    rng = np.random.default_rng(4)
    x = np.where(rng.random(500) < 0.1, np.nan, rng.integers(0, 40, 500) / 7)
    k = RunningQuantile("v", 0.95, 3)
    state, got = k.start(), []
    for lo in range(0, 500, 61):
        state, out = k.step(state, pd.DataFrame({"frame_idx": np.arange(lo, min(500, lo + 61)), "v": x[lo : lo + 61]}))
        got += [np.nan if v is None else v for v in out["running_q"]]
    want = pd.Series(x).expanding(3).quantile(0.95, interpolation="linear").to_numpy()
    assert np.allclose(np.array(got, float), want, equal_nan=True)
