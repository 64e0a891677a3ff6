"""Scalar rules shared by the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def stream_time(t_presentation: Column, t_capture: Column) -> Column:
    return F.coalesce(t_presentation, t_capture)


def due_time(frame_idx: Column, fps: Column) -> Column:
    return frame_idx / fps


def is_available(frame_idx: Column, fps: Column, elapsed: Column) -> Column:
    return due_time(frame_idx, fps) <= elapsed


def information_gain(
    novelty: Column, novelty_at_last: Column, age: Column, half_life: float = 3.0
) -> Column:
    stale = 1.0 - F.pow(F.lit(0.5), age / F.lit(half_life))
    gain = F.greatest(F.lit(0.0), novelty - novelty_at_last) * (0.5 + 0.5 * stale)
    return F.when(age.isNull(), F.lit(1.0)).otherwise(gain)


def trigger_features(
    novelty: Column, scene_change: Column, motion: Column, age: Column, novelty_at_last: Column
) -> list[Column]:
    since = F.coalesce(F.least(age, F.lit(30.0)), F.lit(30.0))
    delta = F.greatest(F.lit(0.0), novelty - F.coalesce(novelty_at_last, F.lit(0.0)))
    return [novelty, scene_change, motion, since / 10.0, delta]


def logistic(features: Sequence[Column], weights: Sequence[float], bias: float) -> Column:
    z = F.lit(float(bias))
    for f, w in zip(features, weights):
        z = z + F.lit(float(w)) * f
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))
    return 1.0 / (1.0 + F.exp(-z))


def too_dark(thumb: Column, limit: float = 25.0) -> Column:
    """NULL where nothing was sampled."""
    from streamlens.functions.vec import mean

    return mean(thumb) < limit


def quantisation_damage(f1: Column, floor: Column, is_reference: Column) -> Column:
    """NULL = not applicable, 0 = none measurable, else how far below the noise floor."""
    return (
        F.when(is_reference | f1.isNull() | floor.isNull(), F.lit(None).cast("double"))
        .when(f1 >= floor, F.lit(0.0))
        .otherwise(floor - f1)
    )


def period_name(period_s: Column) -> Column:
    hz = 1.0 / period_s

    def short(x):
        """Six significant digits without closing zeros, as the name of a timer has them."""
        s = F.format_string("%.0f", x)
        for whole in range(5, 0, -1):
            s = F.when(x < 10.0**whole, F.regexp_replace(F.format_string(f"%.{6 - whole}f", x), r"\.?0+$", "")).otherwise(s)
        return s

    return F.when(period_s <= 0, F.lit("oracle")).otherwise(
        F.when(hz >= 1, F.concat(F.lit("fixed_"), short(hz), F.lit("hz"))).otherwise(
            F.concat(F.lit("fixed_"), short(period_s), F.lit("s"))
        )
    )


def policy_kind(name: Column) -> Column:
    return F.when(name.startswith("fixed") | (name == "oracle"), F.lit("fixed_interval")).otherwise(name)


# The parts of a run's label that name its backend, and those that are not its model.
def backend_of(label: Column) -> Column:
    return (
        F.when(label.contains("control") | label.contains("downsample"), F.lit("control"))
        .when(label.contains("onnx"), F.lit("onnx"))
        .otherwise(F.lit("torch"))
    )


def model_of(label: Column) -> Column:
    out = label
    for old in (" (control, no network)", "@224", " torch fp16", " onnx"):
        out = F.replace(out, F.lit(old), F.lit(""))
    return out


def state_at(state_ids: Column, i: Column) -> Column:
    """State at index ``i`` held to the valid range."""
    return F.element_at(state_ids, F.least(F.greatest(i, F.lit(0)), F.size(state_ids) - 1) + 1)


def agreement_verdict(f1: Column, floor: Column) -> Column:
    return F.when(f1 >= floor, F.lit("at_or_above_floor")).otherwise(F.lit("below_floor"))
