"""Small hand-made traces with answers that can be worked out on paper."""

import numpy as np

from streamlens.operators.layout import lay_out

TRACE = ("stream_id string, frame_idx long, t double, motion double, novelty double, scene_change double,"
         " state_id int, answer string")
A, B = "two chairs beside a closed window", "someone waters the plant on the shelf"


def two_state_rows(name="two", n=300, fps=30.0):
    half = n // 2
    return [(name, i, i / fps, 0.002, 0.01 if i < half else 0.4, 0.0, 0 if i < half else 1, A if i < half else B) for i in range(n)]


def probe_rows(name="probe", n=300, fps=30.0):
    return [(name, i, i / fps, 0.05, 0.5, 0.0, 0, A) for i in range(n)]


def random_rows(name, n, seed, fps=30.0, states=4, scale=1.0):
    rng = np.random.default_rng(seed)
    state = np.cumsum(rng.random(n) < 0.02) % states
    return [(name, i, i / fps, float(m), float(v * scale), float(c), int(s), f"state {s} seen word{i % 3}")
            for i, (m, v, c, s) in enumerate(zip(rng.random(n), rng.random(n), rng.random(n), state))]


def trace(spark, rows):
    return lay_out(spark.createDataFrame(rows, TRACE), ["stream_id"], ["frame_idx"])


def by_row(policy, rows):
    """Reference meaning of a policy: ask it row by row."""
    from streamlens.operators.policies import Context

    out, t_last, v_last, n = [], None, 0.0, 0
    for _, i, t, motion, novelty, change, _, _ in rows:
        fire, _ = policy.decide(Context(i, t, motion, novelty, change, t_last, v_last, n))
        if fire:
            out.append(i)
            t_last, v_last, n = t, novelty, n + 1
    return out
