import numpy as np
import pytest
from pyspark.sql import functions as F

from streamlens.operators import nearest
from streamlens.operators.layout import lay_out

DDL = "stream_id string, frame_idx long, embedding array<double>"


def brute(x):
    """Best dot product with any earlier row, by row."""
    sims = x @ x.T
    return {i: sims[i, :i].max() for i in range(1, len(x))}


def laid_of(spark, streams):
    rows = [(k, i, v) for k, x in streams.items() for i, v in enumerate(x)]
    return lay_out(spark.createDataFrame(rows, DDL), ["stream_id"], ["frame_idx"])


def answers(df):
    out = {}
    for r in df.collect():
        assert out.setdefault(r.stream_id, {}).setdefault(r.frame_idx, r.best_similarity) == r.best_similarity
    return out


def scenes(rng, n, kinds, d=16, spread=0.02):
    """Unit vectors that come back to ``kinds`` scenes in random order."""
    centres = rng.normal(size=(kinds, d))
    x = centres[rng.integers(0, kinds, n)] + spread * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [5, 64, 4096])
def test_equal_to_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    short = rng.normal(size=(3, 6))
    # vectors of any length, ties and repeats; a NULL stream; a stream of one row
    long = np.concatenate([rng.normal(size=(150, 6)) * rng.uniform(0.1, 5, (150, 1)), np.repeat(rng.normal(size=(2, 6)), 20, axis=0)])
    streams = {"a": short, None: long, "z": rng.normal(size=(1, 6))}
    got = answers(nearest.best_earlier(laid_of(spark, {k: x.tolist() for k, x in streams.items()}), block))
    assert set(got) == {"a", None}
    for k in got:
        assert got[k] == pytest.approx(brute(streams[k]))


def test_most_blocks_are_ruled_out(spark):
    x = scenes(np.random.default_rng(3), 3000, 40)
    laid = laid_of(spark, {"s": x.tolist()})
    seen = nearest.candidates(nearest.blocks(laid, 50), ["stream_id"], 50)
    could, wanted = seen.agg(F.sum("_could"), F.sum(F.size("_want"))).first()
    assert could > 3000 * 20 and wanted < 0.2 * could
    assert answers(nearest.best_earlier(laid, 50))["s"] == pytest.approx(brute(x))


def test_a_block_that_all_visit_is_shared_out(spark, chunks):
    """One scene in nearly all rows, streams cut into chunks: blocks have more visitors than a task takes."""
    chunks(100)
    rng = np.random.default_rng(8)
    x = scenes(rng, 600, 1, spread=0.5)
    laid = laid_of(spark, {"s": x.tolist()})
    assert laid.split
    assert answers(nearest.best_earlier(laid, 16))["s"] == pytest.approx(brute(x))


def test_missing_vectors_and_empty_tables(spark):
    laid = laid_of(spark, {"s": [[1.0, 0.0], None, [float("nan"), 1.0], [0.5, 0.5], None, [0.0, 2.0]]})
    got = answers(nearest.best_earlier(laid, 2))
    assert got == {"s": {3: 0.5, 5: 1.0}}
    empty = lay_out(spark.createDataFrame([], DDL), ["stream_id"], ["frame_idx"])
    assert nearest.best_earlier(empty).columns == ["stream_id", "frame_idx", "best_similarity"]
    assert nearest.best_earlier(empty).count() == 0
