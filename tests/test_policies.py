import math

import numpy as np
import pytest
from helpers import by_row, probe_rows, random_rows, trace, two_state_rows

from streamlens.operators.policies import (AdaptiveQuantile, Context, FixedInterval, InformationGain, Learned, Policy, dense_grid,
                                           make_policy, policy_grid)
from streamlens.operators.sweep import sweep
from streamlens.operators.triggers import decisions, in_flight


def fired(spark, rows, policies):
    d = decisions(trace(spark, rows), policies).collect()
    return {(r.stream_id, p): sorted(x.frame_idx for x in d if x.stream_id == r.stream_id and (x.policy, x.point) == p)
            for r in d for p in {(r.policy, r.point)}}


class Gain(InformationGain):
    def decide(self, c):
        if c.t_last_call is None:
            return True, 1.0
        g = max(0.0, c.novelty - c.novelty_at_last_call) * (0.5 + 0.5 * (1 - 0.5 ** (c.since_last_call / self.half_life_s)))
        return c.since_last_call >= self.min_gap_s and g >= self.threshold, g


class Logit(Learned):
    def decide(self, c):
        if c.t_last_call is None:
            return True, 1.0
        f = [c.novelty, c.scene_change, c.motion, min(c.since_last_call, 30.0) / 10, max(0.0, c.novelty - c.novelty_at_last_call)]
        p = 1 / (1 + math.exp(-max(-60, min(60, float(np.dot(self.weights, f)) + self.bias))))
        return c.since_last_call >= self.min_gap_s and p >= self.threshold, p


ROWS = random_rows("a", 700, 1) + random_rows("b", 400, 2)
BOTH = [
    (FixedInterval(0.0), None), (FixedInterval(0.1), None), (FixedInterval(1.0), None), (FixedInterval(0.77), None),
    (make_policy("motion_threshold", 0.9), None), (make_policy("embedding_novelty", 0.97), None),
    (make_policy("embedding_novelty", 0.5, min_gap_s=0.0), None),
    (InformationGain(0.3), Gain(0.3)), (Learned([2.0, 1.0, 1.0, 0.5, 3.0], -3.0, 0.9), Logit([2.0, 1.0, 1.0, 0.5, 3.0], -3.0, 0.9)),
]


@pytest.mark.parametrize("size", [4_000_000, 90])
def test_block_scan_equals_row_by_row(spark, chunks, size):
    chunks(size)
    got = decisions(trace(spark, ROWS), [p for p, _ in BOTH]).toPandas()
    for p, slow in BOTH:
        for name in ("a", "b"):
            mine = sorted(got[(got.stream_id == name) & (got.policy == p.name) & (got.point == p.point)].frame_idx)
            assert mine == by_row(slow or p, [r for r in ROWS if r[0] == name]), (p.name, p.point, name)


@pytest.mark.parametrize("size", [4_000_000, 120])
def test_sweep_advances_all_policies_together(spark, chunks, size):
    chunks(size)
    policies = [p for p, _ in BOTH] + [AdaptiveQuantile(0.9, 2.0, 0.3, 10)]
    got = {(r.stream_id, r.policy, r.point): r.n_calls for r in sweep(trace(spark, ROWS), policies).collect()}
    want = decisions(trace(spark, ROWS), policies).groupBy("stream_id", "policy", "point").count().collect()
    assert got == {(r.stream_id, r.policy, r.point): r["count"] for r in want}


@pytest.mark.parametrize("size", [4_000_000, 100])
def test_adaptive_equals_numpy_quantile(spark, chunks, size):
    chunks(size)
    p = AdaptiveQuantile(0.9, window_s=2.0, min_samples=10)
    got = decisions(trace(spark, ROWS), [p]).toPandas()
    for name in ("a", "b"):
        rows, t_last, want = [r for r in ROWS if r[0] == name], None, []
        for i, r in enumerate(rows):
            hist = [x[4] for x in rows[: i + 1] if x[2] >= r[2] - 2.0]
            ok = t_last is None or (r[2] - t_last >= 0.3 and len(hist) >= 10 and r[4] >= np.quantile(hist, 0.9))
            if ok:
                want.append(i)
                t_last = r[2]
        assert sorted(got[got.stream_id == name].frame_idx) == want


def test_user_policy_sees_only_the_past(spark):
    class Watch(Policy):
        kind = "watch"

        def decide(self, ctx):
            assert ctx.t_last_call is None or ctx.t_last_call < ctx.t
            return ctx.since_last_call >= 1.0, 0.0

    rows = two_state_rows()
    d = decisions(trace(spark, rows), [Watch()])
    assert sorted(r.frame_idx for r in d.collect()) == by_row(Watch(), rows) == list(range(0, 300, 30))


def test_quantile_is_a_rate_controller(spark):
    rows = random_rows("u", 1200, 3)
    n = {q: len(v) for (_, (_, q)), v in fired(spark, rows, [AdaptiveQuantile(q) for q in (0.8, 0.95, 0.99)]).items()}
    assert n[0.8] > n[0.95] > n[0.99]


def test_adaptive_is_scale_free(spark):
    rows = random_rows("low", 900, 4, scale=0.05) + random_rows("high", 900, 5, scale=0.8)
    f = fired(spark, rows, [AdaptiveQuantile(0.95)])
    lo, hi = (len(v) for _, v in sorted(f.items()))
    assert abs(lo - hi) <= 0.25 * max(lo, hi)


def test_registry_and_grids():
    with pytest.raises(ValueError):
        make_policy("nope", 1.0)
    assert FixedInterval(0.25).name == "fixed_4hz" and FixedInterval(2.0).name == "fixed_2s" and FixedInterval(0).name == "oracle"
    assert len(dense_grid("embedding_novelty")) == 60 and len(dense_grid("motion_threshold")) == 55
    assert len(policy_grid(["fixed_interval", "motion_threshold"])) == 18
    assert Context(0, 0.0, 0, 0, 0, None, 0.0, 0).since_last_call == math.inf


def test_scores_of_known_traces(spark):
    every, never, two_s, half = FixedInterval(0.0), FixedInterval(1e6), FixedInterval(2.0), FixedInterval(0.5)
    s = {(r.stream_id, r.point): r for r in sweep(trace(spark, two_state_rows() + probe_rows()), [every, never, two_s, half, FixedInterval(1.0)],
                                                 with_text=True, warmup=0).collect()}
    r = s[("two", 0.0)]
    assert (r.call_fraction, r.validity, r.accuracy, r.staleness_ms_mean) == (1.0, 1.0, 1.0, 0.0)
    r = s[("two", 1e6)]
    assert (r.n_calls, r.event_recall, r.missed_events) == (1, 0.0, 1)
    r = s[("two", 2.0)]
    assert r.false_triggers + r.justified_calls == r.n_calls - 1
    r = s[("two", 0.5)]
    assert (r.total_events, r.event_recall) == (1, 1.0)
    r = s[("probe", 1.0)]
    assert (r.justified_calls, r.false_trigger_rate, r.event_recall) == (0, 1.0, None)


def test_in_flight_rows_are_busy(spark):
    d = in_flight(trace(spark, probe_rows(n=120)), make_policy("embedding_novelty", 0.1, min_gap_s=0.29), 1.0).df.toPandas()
    started = sorted(d[d.outcome == "started"].frame_idx)
    assert started == [0, 30, 60, 90]
    busy = sorted(d[d.outcome == "worker_busy"].frame_idx)
    assert busy == [i for s in started for i in range(s + 9, s + 30)]


def test_a_bank_scans_long_blocks_as_it_steps_through_short_ones():
    import numpy as np

    from streamlens.operators.policies import AdaptiveQuantile, Bank, FixedInterval, InformationGain, Learned, SignalThreshold

    policies = [FixedInterval(0.0), FixedInterval(0.7), SignalThreshold("embedding_novelty", "novelty", 0.6, 0.2), AdaptiveQuantile(0.8, 5.0, 0.2, 10),
                InformationGain(0.2, 3.0, 0.2), Learned([1.0, 0.5, 1.0, -0.2, 2.0], -1.5, 0.5, 0.2)]
    rng = np.random.default_rng(3)
    n = 400
    block = {"t": np.cumsum(rng.choice([0.0, 0.03, 0.3], n)), "frame_idx": np.arange(n), **{c: rng.random(n) for c in ("motion", "novelty", "scene_change")}}
    out = []
    for long, size in ((1, n), (10**9, n), (1, 50), (10**9, 37)):
        bank = Bank(policies)
        bank.LONG = long
        carries, rows = [{} for _ in policies], []
        for lo in range(0, n, size):
            fired, carries = bank.fire({k: v[lo : lo + size] for k, v in block.items()}, carries)
            rows.append(fired)
        out.append(np.vstack(rows))
    assert all((out[0] == x).all() for x in out[1:]) and out[0].sum(0).min() > 1
