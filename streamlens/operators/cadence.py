"""Depth of queues at a fixed cadence: held between events and sampled at every tick, so busy moments do not weigh more.

An average over the rows of a queue looks at it exactly when something happens to it. Here a depth counts for as many ticks
as it was held, rows or no rows. Ticks are not made one by one: how many fall between two events is a difference of two
quotients, so a quiet week costs one row for each window it spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.operators.fold import Kernel
from streamlens.operators.layout import Laid, join_on


def depth_at_cadence(samples: Laid, window_us: int, tick_us: int = 50_000, t_us: str = "t_us", depth: str = "depth") -> DataFrame:
    """keys, window_us (its start), ticks, mean_depth, peak_depth of every window that is over by the key's last event.

    Ticks are the multiples of ``tick_us`` from a key's first event to before its last; a tick sees the last event at or before
    it, of several at one time the last in order. Windows without a tick are left out.
    """
    laid = samples.lag(_t0=t_us, _d0=depth)
    a, b = F.col("_t0"), F.col(t_us)
    held = laid.result().where(F.col("_t0").isNotNull() & (F.col("_t0") < F.col(t_us)))
    keys = list(samples.keys)
    spans = held.select(*keys, a.alias("a"), b.alias("b"), F.col("_d0").alias("d"), F.explode(F.sequence(F.expr(f"_t0 div {window_us}"), F.expr(f"({t_us} - 1) div {window_us}"))).alias("w"))
    spans = spans.withColumn("n", _ticks_before(F.least("b", (F.col("w") + 1) * window_us), tick_us) - _ticks_before(F.greatest("a", F.col("w") * window_us), tick_us))
    sums = spans.where("n > 0").groupBy(*keys, "w").agg(F.sum("n").alias("ticks"), F.sum(F.col("d") * F.col("n")).alias("s"), F.max("d").alias("peak_depth"))
    ends = samples.df.groupBy(*keys).agg(F.expr(f"max({t_us}) div {window_us}").alias("_open"))
    return join_on(sums, ends, keys).where("w < _open").select(
        *keys, (F.col("w") * window_us).alias("window_us"), "ticks", (F.col("s") / F.col("ticks")).alias("mean_depth"), "peak_depth")


def _ticks_before(t: Column, tick_us: int) -> Column:
    """Multiples of the tick from 0 on that are less than t (whole numbers, no rounding)."""
    up = t + F.lit(tick_us - 1)
    return ((up - F.pmod(up, F.lit(tick_us))) / F.lit(tick_us)).cast("long")


@dataclass
class DepthAtCadence(Kernel):
    """The same as a kernel, for streams: a window's row comes once an event at or after its end has come."""

    window_us: int
    tick_us: int = 50_000
    depth: str = "depth"

    def __post_init__(self) -> None:
        self.columns = ["t_us", self.depth]
        self.schema = "window_us long, ticks long, mean_depth double, peak_depth int"

    def start(self):
        return {"t": None, "d": None, "w": None, "n": 0, "s": 0, "peak": None}

    def step(self, state, pdf):
        t, d = pdf["t_us"].to_numpy(np.int64), pdf[self.depth].to_numpy(np.int64)
        if state["t"] is not None:
            t, d = np.concatenate([[state["t"]], t]), np.concatenate([[state["d"]], d])
        a, b = t[:-1], t[1:]
        real = b > a
        a, b, v = a[real], b[real], d[:-1][real]
        first, last = a // self.window_us, (b - 1) // self.window_us
        many = last - first + 1
        w = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        a, b, v = np.repeat(a, many), np.repeat(b, many), np.repeat(v, many)
        up = self.tick_us - 1
        n = (np.minimum(b, (w + 1) * self.window_us) + up) // self.tick_us - (np.maximum(a, w * self.window_us) + up) // self.tick_us
        w, v, n = w[n > 0], v[n > 0], n[n > 0]
        s, peak = v * n, v
        if state["n"]:
            w, n, s, peak = (np.concatenate([[x], y]) for x, y in zip((state["w"], state["n"], state["s"], state["peak"]), (w, n, s, peak)))
        now = {"t": int(t[-1]), "d": int(d[-1]), "w": None, "n": 0, "s": 0, "peak": None}
        if not len(w):
            return now, None
        at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        w, n, s, peak = w[at], np.add.reduceat(n, at), np.add.reduceat(s, at), np.maximum.reduceat(peak, at)
        if w[-1] == now["t"] // self.window_us:  # not over yet
            now.update(w=int(w[-1]), n=int(n[-1]), s=int(s[-1]), peak=int(peak[-1]))
            w, n, s, peak = w[:-1], n[:-1], s[:-1], peak[:-1]
        return now, pd.DataFrame({"window_us": w * self.window_us, "ticks": n, "mean_depth": s / np.maximum(n, 1), "peak_depth": peak.astype(np.int32)})
