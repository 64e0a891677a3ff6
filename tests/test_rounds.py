"""Chunks of a split stream settle in a few rounds, long before there are as many as chunks."""

import numpy as np
import pytest
from helpers import TRACE, random_rows

from streamlens.operators import fold as F_
from streamlens.operators.fold import fold
from streamlens.operators.layout import lay_out
from streamlens.operators.policies import FixedInterval, InformationGain, Learned, SignalThreshold, Trigger, make_policy
from streamlens.operators.sweep import sweep

QUIET = [("q", i, i / 30.0, 0.001, 0.01, 0.0, 0, "still") for i in range(1, 500)]
LOUD_FIRST = [("q", 0, 0.0, 0.5, 0.9, 0.5, 0, "start"), *QUIET]
POLICIES = [
    InformationGain(0.2, 3.0, 0.2), InformationGain(0.3), Learned([1.0, 1.0, 1.0, 0.1, 2.0], -3.0), Learned([3.0, 0.5, 1.0, 0.0, 2.0], -1.5, 0.6),
    SignalThreshold("embedding_novelty", "novelty", 0.6, 0.2), FixedInterval(0.5)]


@pytest.fixture
def rounds(monkeypatch):
    seen, real = [], F_._run_states

    def count(df, keys, order, kernel, cold, whole=False):
        seen.append(cold)
        return real(df, keys, order, kernel, cold, whole)

    monkeypatch.setattr(F_, "_run_states", count)
    return seen


def both(spark, tmp_path, chunks, rows, run):
    spark.createDataFrame(rows, TRACE).repartition(3).write.parquet(str(tmp_path / "rows"))
    df, out = spark.read.parquet(str(tmp_path / "rows")), []
    for size in (4_000_000, len(rows) // 50):
        chunks(size)
        got = run(lay_out(df, ["stream_id"], ["frame_idx"])).collect()
        out.append(sorted(str([round(x, 7) if isinstance(x, float) else x for x in r]) for r in got))
    return out


# a chunk of the busy stream is two seconds, some seven gaps: entries are forgotten within a few chunks, far from a real one's size
@pytest.mark.parametrize("rows,most", [(LOUD_FIRST, 1), (random_rows("a", 3000, 3), 10)], ids=["quiet", "busy"])
def test_fifty_chunks_settle_in_few_rounds(spark, tmp_path, chunks, rounds, rows, most):
    """A quiet stream hands its first call through all chunks at once; a busy one forgets its entry after a while."""
    whole, cut = both(spark, tmp_path, chunks, rows, lambda laid: fold(laid, Trigger(POLICIES)))
    assert whole == cut and whole
    assert rounds.count(True) == 1 and rounds.count(False) <= most


@pytest.mark.parametrize("rows,most", [(LOUD_FIRST, 1), (random_rows("a", 3000, 3), 10)], ids=["quiet", "busy"])
def test_sweeps_settle_too(spark, tmp_path, chunks, rounds, rows, most):
    whole, cut = both(spark, tmp_path, chunks, rows, lambda laid: sweep(laid, POLICIES))
    assert whole == cut and whole
    assert rounds.count(False) <= most


def block(rows):
    cols = ["frame_idx", "t", "motion", "novelty", "scene_change"]
    return {c: np.array([r[i] for r in rows], float) for c, i in zip(cols, (1, 2, 3, 4, 5))}


@pytest.mark.parametrize("policy", [InformationGain(0.2, 3.0, 0.3), InformationGain(0.6, 1.0, 0.0), Learned([3.0, 0.5, 1.0, 0.2, 2.0], -4.0), Learned([1.0, 1.0, 1.0, -0.5, -2.0], -1.0, 0.4),
                                    make_policy("learned", 0.5, weights=[0.0, 0.0, 0.0, 1.0, 0.0], bias=-2.0)])
def test_what_passes_never_fires(policy):
    """An outline may be unsure, but where it is sure, no row fires; made whole or joined from parts."""
    rng = np.random.default_rng(2)
    sure = 0
    for k in range(300):
        b = block([(r[0], r[1], r[2] + 10, r[3] * 0.3, r[4] * rng.random(), r[5] * 0.3) for r in random_rows("a", 40, k)])
        halves = [{c: x[s] for c, x in b.items()} for s in (slice(0, 13), slice(13, 40))]
        carry = {"t": float(rng.uniform(0, 10)), "v": float(rng.uniform(0, 1))}
        fired = len(policy.scan(b, dict(carry))[0])
        for o in (policy.joined([policy.outline(b)]), policy.joined([policy.outline(h) for h in halves])):
            if policy.passes(o, carry):
                sure += 1
                assert fired == 0
        if isinstance(policy, InformationGain):
            assert policy.passes(policy.outline(b), carry) == (fired == 0)
    assert sure > 0
