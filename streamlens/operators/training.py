"""Learning a trigger: examples from a teacher that sees state changes, and a logistic fit."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.operators.fold import Kernel, fold
from streamlens.operators.layout import Laid
from streamlens.operators.policies import LEARNED_FEATURES
from streamlens.session import stored


@dataclass
class Teacher(Kernel):
    """Calls when the state changed since its last call; every later row becomes an example."""

    min_gap_s: float = 0.3

    def __post_init__(self):
        self.columns = ["frame_idx", "t", "motion", "novelty", "scene_change", "state_id"]
        self.schema = "frame_idx long, " + ", ".join(f"{f} double" for f in LEARNED_FEATURES) + ", label double"

    def start(self):
        return {"t": None, "s": None, "v": 0.0}

    def step(self, state, pdf):
        t, v = pdf["t"].to_numpy(float), pdf["novelty"].to_numpy(float)
        s = pdf["state_id"].to_numpy(np.int64)
        t_last, s_last, v_last = state["t"], state["s"], state["v"]
        n, i = len(t), 0
        age, base, label = np.empty(n), np.empty(n), np.zeros(n)
        skip = 0
        if t_last is None and n:
            t_last, s_last, v_last, i, skip = float(t[0]), int(s[0]), float(v[0]), 1, 1
        while i < n:
            hit = np.flatnonzero((s[i:] != s_last) & (t[i:] - t_last >= self.min_gap_s))[:1]
            j = i + int(hit[0]) if len(hit) else n - 1
            age[i : j + 1], base[i : j + 1] = t[i : j + 1] - t_last, v_last
            if len(hit):
                label[j] = 1.0
                t_last, s_last, v_last = float(t[j]), int(s[j]), float(v[j])
            i = j + 1
        out = pd.DataFrame({
            "frame_idx": pdf["frame_idx"], "novelty": v, "scene_change": pdf["scene_change"], "motion": pdf["motion"],
            "since_last_call": np.minimum(age, 30.0) / 10.0, "novelty_delta": np.maximum(0.0, v - base), "label": label})
        return {"t": t_last, "s": s_last, "v": v_last}, out.iloc[skip:]


def teacher_examples(laid: Laid, min_gap_s: float = 0.3) -> DataFrame:
    return fold(laid, Teacher(min_gap_s))


def fit(examples: DataFrame, l2: float = 1e-3, max_iter: int = 50, tolerance: float = 1e-10) -> dict[str, Any]:
    """Class-balanced logistic fit by Newton steps; weights come back on the raw features.

    The loss is the weighted mean of the log losses plus ``l2 / 2`` times the squared weights of the standardised features; the
    bias is free. Each step is one aggregate over the stored examples: the sums of gradient and curvature are made in the
    executors, a few dozen numbers reach the driver. A step that does not lessen the loss is halved. ``gradient`` is what is
    left of the slope at the weights returned, a number for each feature and one for the bias.
    """
    examples = stored(examples, "examples")  # made by a fold; read for the counts, the steps and the report
    x = [F.col(f).cast("double") for f in LEARNED_FEATURES]
    first = examples.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    n, pos = first["n"], first["pos"]
    if not n:
        raise ValueError("there is nothing to learn from: the table of examples is empty")
    if not pos:
        raise ValueError("every example has the label 0; a trigger cannot be learned from them")
    weight = balanced(n, pos)
    total = F.sum(weight)
    moments = examples.agg(total.alias("w"), *[(F.sum(weight * c) / total).alias(f"m{i}") for i, c in enumerate(x)]).first()
    mean = np.array([moments[f"m{i}"] for i in range(len(x))])
    spread = examples.agg(*[(F.sum(weight * (c - F.lit(m)) ** 2) / total).alias(f"v{i}") for i, (c, m) in enumerate(zip(x, mean.tolist()))]).first()
    scale = np.sqrt(np.array(list(spread), float))
    scale[scale == 0] = 1.0
    z = [(c - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(x, mean, scale)] + [F.lit(1.0)]
    ridge = np.array([l2] * len(x) + [0.0])

    def slopes(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        m = sum((F.lit(float(a)) * c for a, c in zip(w, z)), F.lit(0.0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-m))
        loss = F.greatest(m, F.lit(0.0)) - m * F.col("label") + F.log1p(F.exp(-F.abs(m)))
        d, c = weight * (p - F.col("label")), weight * p * (F.lit(1.0) - p)
        pairs = [(i, j) for i in range(len(z)) for j in range(i + 1)]
        row = examples.agg(F.sum(weight * loss), *[F.sum(d * q) for q in z], *[F.sum(c * z[i] * z[j]) for i, j in pairs]).first()
        sums = np.array(list(row), float) / moments["w"]
        curve = np.zeros((len(z), len(z)))
        for (i, j), v in zip(pairs, sums[1 + len(z) :]):
            curve[i, j] = curve[j, i] = v
        return sums[0] + 0.5 * float(ridge @ w**2), sums[1 : 1 + len(z)] + ridge * w, curve + np.diag(ridge)

    w, step = np.zeros(len(z)), None
    loss, gradient, curve = slopes(w)
    for _ in range(max_iter):
        if np.abs(gradient).max() < tolerance:
            break
        step = np.linalg.lstsq(curve, gradient, rcond=None)[0]
        for _ in range(30):
            after = slopes(w - step)
            if after[0] <= loss + 1e-15:
                break
            step = step / 2
        else:
            break
        w = w - step
        loss, gradient, curve = after
        if np.abs(step).max() < 1e-14:
            break
    weights = (w[:-1] / scale).tolist()
    bias = float(w[-1] - (w[:-1] * mean / scale).sum())
    report = evaluate(examples, weights, bias).first().asDict()
    return {"weights": weights, "bias": bias, "feature_names": list(LEARNED_FEATURES), "gradient": gradient.tolist(), "scale": scale.tolist(), **report}


def balanced(n: int, pos: float):
    """Both labels get half of the weight, and an example has a weight of 1 on average."""
    return F.when(F.col("label") > 0, F.lit(n / (2.0 * pos))).otherwise(F.lit(n / (2.0 * max(n - pos, 1.0))))


def slope_at(examples: DataFrame, weights: list[float], bias: float, l2: float = 1e-3) -> DataFrame:
    """(feature, slope): how far the loss of ``fit`` still falls along each weight and the bias; 0 at the optimum. Worked out
    from the examples by themselves, with the raw features."""
    n, pos = examples.agg(F.count("*"), F.sum("label")).first()
    w = balanced(n, pos)
    x = [F.col(f).cast("double") for f in LEARNED_FEATURES]
    z = sum((F.lit(float(a)) * c for a, c in zip(weights, x)), F.lit(float(bias)))
    d = w * (F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.col("label"))
    total = F.sum(w)
    variance = lambda c: F.sum(w * c * c) / total - (F.sum(w * c) / total) ** 2
    slopes = [F.sum(d * c) / total + F.lit(l2 * a) * variance(c) for a, c in zip(weights, x)] + [F.sum(d) / total]
    return examples.agg(F.array(*slopes).alias("s")).select(
        F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in (*LEARNED_FEATURES, "bias")]).alias("feature"), F.col("s").alias("slope"))).alias("x")).select("x.feature", "x.slope")


def evaluate(examples: DataFrame, weights: list[float], bias: float) -> DataFrame:
    from streamlens.functions.scalars import logistic

    p = logistic([F.col(f) for f in LEARNED_FEATURES], weights, bias) >= 0.5
    y = F.col("label") > 0
    tp, fp, fn = F.count_if(p & y), F.count_if(p & ~y), F.count_if(~p & y)
    return examples.agg(
        F.count("*").alias("n_examples"), F.count_if(y).alias("n_positive"), F.avg("label").alias("positive_rate"),
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))
