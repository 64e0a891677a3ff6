import numpy as np
import pytest
from helpers import random_rows, trace

from streamlens.operators import cache, training
from streamlens.operators.cache import Store
from streamlens.operators.layout import lay_out
from streamlens.operators.policies import LEARNED_FEATURES, FixedInterval

DDL = ("stream_id string, frame_idx long, t double, motion double, novelty double, scene_change double, state_id long,"
       " answer string, embedding array<double>")


def return_trace(spark):
    """States 0, 1, 0 with one embedding per state."""
    rows = []
    for i in range(300):
        s = 1 if 100 <= i < 200 else 0
        rows.append(("r", i, i / 30, 0.0, 0.0, 0.0, s, f"state {s}", [1.0 - s, float(s)]))
    return lay_out(spark.createDataFrame(rows, DDL), ["stream_id"], ["frame_idx"])


def test_store_rules():
    s = Store(0.9, 2, 5.0)
    e = np.array([1.0, 0.0])
    s.add(e, 7, 0, 0.0)
    assert s.lookup(e, 4.9)[0] == 0 and s.lookup(e, 5.1)[0] is None
    assert s.entry(0) == (7, 0, 0.0)
    s.add(np.array([0.0, 1.0]), 8, 0, 1.0)
    s.add(np.array([0.7, -0.7]), 9, 0, 2.0)
    assert s.evicted == 1 and s.info["frame"].tolist() == [7, 9] and s.keys.shape == (2, 2)
    again = Store(0.9, 2, 5.0, s.saved())
    assert again.info.tolist() == s.info.tolist() and (again.keys == s.keys).all()


@pytest.mark.parametrize("size", [4_000_000, 60])
def test_cache_accounting(spark, chunks, size):
    chunks(size)
    laid = return_trace(spark)
    thr = [None, 0.99, 0.0]
    d = cache.replay(laid, cache.lookups(laid, FixedInterval(1.0), thr), thr).collect()
    by = {r.cache_threshold: r for r in d}
    good, bad, none = by[0.99], by[0.0], by[None]
    assert good.n_hits > 0 and good.n_calls < good.n_triggers and good.false_hits == 0 and good.validity == none.validity
    assert bad.false_hits > 0 and bad.validity < 1.0
    assert good.staleness_ms_mean > none.staleness_ms_mean and none.n_hits == 0 and none.calls_avoided == 0


@pytest.mark.parametrize("size", [4_000_000, 37])
def test_lookups_equal_a_plain_loop(spark, chunks, size):
    chunks(size)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [("s", i, i / 30, 0.0, 0.0, 0.0, int(i % 3), "", x[i].tolist()) for i in range(200)]
    laid = lay_out(spark.createDataFrame(rows, DDL), ["stream_id"], ["frame_idx"])
    got = cache.lookups(laid, FixedInterval(0.0), [0.6], size=5, max_age=1.0).orderBy("frame_idx").collect()
    entries, want = [], []
    for i in range(200):
        t = i / 30
        best = None
        for e in sorted(entries, key=lambda e: (-(e["e"] @ x[i]), e["n"])):
            if e["e"] @ x[i] < 0.6:
                break
            if t - e["t"] <= 1.0:
                best = e
                break
        if best:
            best["h"] += 1
            want.append((True, best["n"]))
        else:
            entries.append({"e": x[i], "t": t, "n": i, "h": 0})
            if len(entries) > 5:
                entries.pop(min(range(len(entries)), key=lambda k: (entries[k]["h"], entries[k]["t"])))
            want.append((False, i))
    assert [(r.hit, r.evidence_frame) for r in got] == want


def test_best_earlier_similarity_over_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 4))
    rows = [("s", i, i / 30, 0.0, 0.0, 0.0, 0, "", x[i].tolist()) for i in range(50)]
    laid = lay_out(spark.createDataFrame(rows, DDL), ["stream_id"], ["frame_idx"])
    d = {r.frame_idx: r.best_similarity for r in cache.best_earlier_similarity(laid, block=7).collect()}
    assert 0 not in d and len(d) == 49
    for i in range(1, 50):
        assert d[i] == pytest.approx((x[:i] @ x[i]).max())


def test_verdict(spark):
    def run(rows):
        return cache.verdict(spark.createDataFrame(rows, "cache_threshold double, validity_mean double, calls_avoided_pct_mean double, calls_per_min_mean double")).first()

    base = (None, 0.9, 0.0, 30.0)
    assert run([base, (0.9, 0.9, 12.0, 1.0), (0.8, 0.5, 60.0, 1.0)]).recommendation == "keep"
    assert run([base, (0.9, 0.9, 2.0, 1.0)]).recommendation == "cut"
    assert run([base, (0.9, 0.5, 50.0, 1.0)]).recommendation == "cut"
    assert run([(0.9, 0.5, 50.0, 1.0)]).recommendation == "inconclusive"


@pytest.mark.parametrize("size", [4_000_000, 150])
def test_teacher_and_fit(spark, chunks, size):
    chunks(size)
    rows = random_rows("a", 600, 11)
    # Make novelty follow the state changes so that there is something to learn.
    state = [r[6] for r in rows]
    rows = [(*r[:4], 0.9 if i and state[i] != state[i - 1] else 0.1 * r[4], *r[5:]) for i, r in enumerate(rows)]
    ex = training.teacher_examples(trace(spark, rows), 0.0)
    assert ex.count() == 599
    want = sum(a != b for a, b in zip(state, state[1:]))
    assert ex.filter("label = 1").count() == want
    f = training.fit(ex)
    assert f["recall"] > 0.9 and f["weights"][0] + f["weights"][4] > 0 and f["n_positive"] == want


def test_fit_is_the_optimum(spark):
    """Against Newton steps in numpy on the same loss, and the slope worked out apart."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.random(400), rng.random(400), rng.random(400) * 5, rng.random(400), np.zeros(400)])
    y = (rng.random(400) < 1 / (1 + np.exp(-(3 * x[:, 0] - 0.4 * x[:, 2] - 1.5)))).astype(float)
    ex = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{f} double" for f in LEARNED_FEATURES) + ", label double")
    got = training.fit(ex)
    w = np.where(y > 0, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    mean = (w[:, None] * x).sum(0) / w.sum()
    scale = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / w.sum())
    scale[scale == 0] = 1
    z, b = np.column_stack([(x - mean) / scale, np.ones(400)]), np.zeros(6)
    ridge = np.array([1e-3] * 5 + [0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + np.diag(ridge), z.T @ (w * (p - y)) / w.sum() + ridge * b)
    assert np.allclose(got["weights"], b[:5] / scale, atol=1e-7) and np.isclose(got["bias"], b[5] - (b[:5] * mean / scale).sum(), atol=1e-7)
    assert max(abs(r.slope) for r in training.slope_at(ex, got["weights"], got["bias"]).collect()) < 1e-8
    off = training.slope_at(ex, [a + 0.1 for a in got["weights"]], got["bias"]).collect()
    assert max(abs(r.slope) for r in off) > 1e-3


def test_fit_refuses_no_positives(spark):
    rows = [("s", i, i / 30, 0.0, 0.0, 0.0, 0, "") for i in range(10)]
    with pytest.raises(ValueError, match="label 0"):
        training.fit(training.teacher_examples(trace(spark, rows)))
