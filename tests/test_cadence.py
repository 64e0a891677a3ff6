"""Depth at a cadence against ticks made one by one."""

import numpy as np
import pandas as pd
import pytest

from streamlens.operators.cadence import DepthAtCadence, depth_at_cadence
from streamlens.operators.fold import fold
from streamlens.operators.layout import lay_out

DDL = "k string, t_us long, n long, depth int"


def brute(rows, window, tick):
    out = []
    for key in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == key)
        lo, hi = mine[0][0], mine[-1][0]
        seen = {}
        for x in range(-(-lo // tick) * tick, hi, tick):
            seen.setdefault(x // window, []).append([d for t, _, d in mine if t <= x][-1])
        out += [(key, w * window, len(d), round(sum(d) / len(d), 9), max(d)) for w, d in seen.items() if (w + 1) * window <= hi]
    return sorted(out)


def some(seed, n=80, far=4000):
    rng = np.random.default_rng(seed)
    return [(k, int(t), i, int(rng.integers(0, 9))) for k in "ab" for i, t in enumerate(rng.integers(0, far, n))]


@pytest.mark.parametrize("seed,window,tick", [(0, 100, 7), (1, 100, 10), (2, 50, 64), (3, 1000, 1)])
@pytest.mark.parametrize("size", [None, 9])
def test_closed_form_and_kernel(spark, chunks, seed, window, tick, size):
    rows = some(seed) + [("quiet", 5, 0, 3), ("quiet", 3990, 1, 4), ("one", 7, 0, 1)]
    want = brute(rows, window, tick)
    if size:
        chunks(size)
    laid = lay_out(spark.createDataFrame(rows, DDL), ["k"], ["t_us", "n"])
    key = lambda d: sorted((r.k, r.window_us, r.ticks, round(r.mean_depth, 9), r.peak_depth) for r in d.collect())
    assert key(depth_at_cadence(laid, window, tick)) == want
    assert any(r[0] == "quiet" for r in want) or window < tick
    if not size:
        assert key(fold(laid, DepthAtCadence(window, tick))) == want


def test_busy_moments_do_not_weigh_more():
    """Deep for one second with many rows, empty for nine with none: the mean is a tenth, not nearly all."""
    t = np.concatenate([np.arange(0, 1_000_000, 10_000), [1_000_000, 10_000_000]])
    d = np.concatenate([np.full(100, 10), [0, 0]])
    k = DepthAtCadence(10_000_000, 50_000)
    _, out = k.step(k.start(), pd.DataFrame({"t_us": t, "depth": d}))
    assert out.values.tolist() == [[0, 200, 1.0, 10]]


def test_any_cut_into_batches_gives_the_same():
    rows = pd.DataFrame([r for r in some(5) if r[0] == "a"], columns=["k", "t_us", "n", "depth"]).sort_values(["t_us", "n"], ignore_index=True)
    k = DepthAtCadence(100, 7)
    _, want = k.step(k.start(), rows)
    for size in (1, 3, 11):
        state, got = k.start(), []
        for lo in range(0, len(rows), size):
            state, out = k.step(state, rows.iloc[lo : lo + size])
            got.append(out)
        assert pd.concat(got, ignore_index=True).equals(want.reset_index(drop=True))
