"""Ordered per-stream signals: change since the previous row, distance to a remembered reference,
and the columns that follow the last call or the last state change."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamlens.functions import vec
from streamlens.operators.fold import Kernel, fold
from streamlens.operators.layout import Laid, join_on
from streamlens.operators.policies import AdaptiveQuantile
from streamlens.session import cut_lineage


# -- change since the previous row ------------------------------------------------------------
def motion(laid: Laid, thumb: str = "thumb", out: str = "motion") -> Laid:
    """Mean absolute thumbnail difference / 255; 0 on the first row."""
    laid = laid.lag(_p=thumb)
    value = F.coalesce(vec.mean_abs_diff(F.col(thumb), F.col("_p")) / 255.0, F.lit(0.0))
    return laid.transform(lambda d: d.withColumn(out, value).drop("_p"))


def scene_change(laid: Laid, embedding: str = "embedding", out: str = "scene_change") -> Laid:
    """1 - dot with the previous row, unclamped; 0 on the first row."""
    laid = laid.lag(_p=embedding)
    value = F.when(F.col("_p").isNull(), F.lit(0.0)).otherwise(1.0 - vec.dot(F.col(embedding), F.col("_p")))
    return laid.transform(lambda d: d.withColumn(out, value).drop("_p"))


def interval_ms(laid: Laid, t: str = "t", out: str = "interval_ms") -> Laid:
    laid = laid.lag(_p=t)
    return laid.transform(lambda d: d.withColumn(out, (F.col(t) - F.col("_p")) * 1000.0).drop("_p"))


def transitions(laid: Laid, state: str = "state_id") -> Laid:
    """Rows on which the state differs from the previous row's."""
    laid = laid.lag(prev_state=state)
    return laid.transform(lambda d: d.filter(F.col(state) != F.col("prev_state")))


# -- distance to a rolling reference ----------------------------------------------------------
def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in col])


def _cells(col: pd.Series) -> np.ndarray:
    return np.stack([np.stack([np.asarray(c, dtype=np.float64) for c in x]) for x in col])


@dataclass
class Reference(Kernel):
    """Half-life weighted, re-normalised reference per stream.

    The distance is taken before the row enters the reference and is 0 until ``min_updates`` rows
    have. With ``cells`` there is one reference per cell and the distance is the mean of the
    ``top_k`` largest cell distances, held to [0, 2].
    """

    half_life: float = 2.0
    min_updates: int = 5
    column: str = "embedding"
    cells: bool = False
    top_k: int = 3
    emit_cells: bool = False
    tolerance: float = 1e-12
    time: str = "t"

    def __post_init__(self):
        self.columns = ["frame_idx", self.time, self.column]
        value = "cell_distance array<double>" if self.emit_cells else "novelty double"
        self.schema = "frame_idx long, " + value

    def start(self):
        return {"ref": None, "t": None, "n": 0}

    def same(self, a, b):
        if a["n"] != b["n"] and min(a["n"], b["n"]) < self.min_updates:
            return False
        if a["t"] != b["t"] or (a["ref"] is None) != (b["ref"] is None):
            return False
        return a["ref"] is None or bool(
            np.max(np.abs(np.array(a["ref"]) - np.array(b["ref"]))) <= self.tolerance
        )

    def step(self, state, pdf):
        x = _cells(pdf[self.column]) if self.cells else _matrix(pdf[self.column])
        t = pdf[self.time].to_numpy(dtype=np.float64)
        ref = None if state["ref"] is None else np.array(state["ref"])
        t_last, n = state["t"], state["n"]
        out = []
        for i in range(len(t)):
            e = x[i]
            if self.emit_cells:
                out.append(np.zeros(len(e)) if ref is None else 1.0 - (ref * e).sum(-1))
            elif ref is None or n < self.min_updates:
                out.append(0.0)
            elif self.cells:
                d = np.sort(1.0 - (ref * e).sum(-1))[::-1][: max(1, min(self.top_k, len(e)))]
                out.append(float(min(2.0, max(0.0, d.mean()))))
            else:
                out.append(float(1.0 - ref @ e))
            if ref is None:
                ref, n = e.copy(), 1
            else:
                dt = max(0.0, t[i] - t_last)
                w = 1.0 - 0.5 ** (dt / self.half_life) if self.half_life > 0 else 1.0
                ref = (1.0 - w) * ref + w * e
                norm = np.sqrt((ref * ref).sum(-1, keepdims=True))
                ref = np.divide(ref, norm, out=ref, where=norm > 0)
                n += 1
            t_last = float(t[i])
        name = "cell_distance" if self.emit_cells else "novelty"
        rows = pd.DataFrame({"frame_idx": pdf["frame_idx"].to_numpy(), name: out})
        return {"ref": None if ref is None else ref.tolist(), "t": t_last, "n": n}, rows


@dataclass
class Combined(Kernel):
    """Motion, scene change and novelty (and patch novelty when ``cells`` is set) in one pass."""

    half_life: float = 2.0
    min_updates: int = 5
    top_k: int = 3
    cells: bool = False

    def __post_init__(self):
        self.pooled = Reference(self.half_life, self.min_updates)
        self.patch = Reference(self.half_life, self.min_updates, "cells", True, self.top_k)
        self.columns = ["frame_idx", "t", "embedding", "thumb"] + (["cells"] if self.cells else [])
        self.schema = "frame_idx long, motion double, scene_change double, novelty double" + (
            ", novelty_patch double" if self.cells else ""
        )

    def start(self):
        return {"pooled": self.pooled.start(), "patch": self.patch.start(), "emb": None, "thumb": None}

    def same(self, a, b):
        return (
            a["emb"] == b["emb"] and a["thumb"] == b["thumb"]
            and self.pooled.same(a["pooled"], b["pooled"]) and self.patch.same(a["patch"], b["patch"])
        )

    def step(self, state, pdf):
        pooled, rows = self.pooled.step(state["pooled"], pdf)
        emb, thumb = _matrix(pdf["embedding"]), _matrix(pdf["thumb"])
        rows["scene_change"] = self._against_previous(emb, state["emb"], lambda a, b: 1.0 - (a * b).sum(-1))
        rows["motion"] = self._against_previous(thumb, state["thumb"], lambda a, b: np.abs(a - b).mean(-1) / 255.0)
        patch = state["patch"]
        if self.cells:
            patch, cell_rows = self.patch.step(patch, pdf)
            rows["novelty_patch"] = cell_rows["novelty"].to_numpy()
        out_cols = ["frame_idx", "motion", "scene_change", "novelty"] + (["novelty_patch"] if self.cells else [])
        return {"pooled": pooled, "patch": patch, "emb": emb[-1].tolist(), "thumb": thumb[-1].tolist()}, rows[out_cols]

    @staticmethod
    def _against_previous(x, before, fn):
        out = np.zeros(len(x))
        if before is not None:
            out[0] = fn(x[0], np.array(before))
        out[1:] = fn(x[1:], x[:-1])
        return out


def reference_novelty(laid: Laid, **params) -> DataFrame:
    return fold(laid, Reference(**params))


def combined_signals(laid: Laid, **params) -> DataFrame:
    return fold(laid, Combined(**params))


# -- rolling quantile -------------------------------------------------------------------------
@dataclass
class RollingQuantile(Kernel):
    """Quantile of the last ``window_s`` seconds, current row included; NULL below ``min_samples``."""

    q: float
    window_s: float
    min_samples: int = 30

    def __post_init__(self):
        self.columns = ["frame_idx", "t", "novelty"]
        self.schema = "frame_idx long, threshold double"
        self._rule = AdaptiveQuantile(self.q, self.window_s, 0.0, self.min_samples)

    def start(self):
        return {"h": [[], []]}

    def step(self, state, pdf):
        ht, hv = state["h"]
        t = np.concatenate([np.array(ht, float), pdf["t"].to_numpy(float)])
        v = np.concatenate([np.array(hv, float), pdf["novelty"].to_numpy(float)])
        thr = self._rule._thresholds(t, v)[len(ht):]
        keep = t >= t[-1] - self.window_s
        thr = [None if np.isnan(x) else float(x) for x in thr]
        out = pd.DataFrame({"frame_idx": pdf["frame_idx"].to_numpy(), "threshold": thr})
        return {"h": [t[keep].tolist(), v[keep].tolist()]}, out


# -- columns that follow calls and state changes ----------------------------------------------
def held_answer(laid: Laid, fired: Column, carry: list[str], prefix: str = "held_") -> Laid:
    """Values of the latest fired row, carried forward (NULL before the first)."""
    laid = laid.last(_held=F.when(fired, F.struct(*carry)))
    return laid.transform(
        lambda d: d.withColumns({prefix + c: F.col("_held")[c] for c in carry}).drop("_held")
    )


def staleness_ms(frame_idx: Column, held_frame: Column, fps: float) -> Column:
    return (frame_idx - held_frame) / F.lit(fps) * 1000.0


def call_labels(calls: Laid, state: str = "state_id") -> Laid:
    """On fired rows only: did the state change since the previous call? NULL on the first."""
    calls = calls.lag(prev_call_state=state)
    return calls.transform(
        lambda d: d.withColumn("justified", F.col(state) != F.col("prev_call_state"))
    )


def scene_states(laid: Laid, answer: str = "answer", t: str = "t") -> DataFrame:
    """Islands of equal consecutive answers: since when, first evidence row, confirmations. No answer (NULL) is an island too."""
    laid = laid.row_number("_first").lag(_p=answer)
    changed = F.when((F.col("_first") == 0) | ~F.col("_p").eqNullSafe(F.col(answer)), 1).otherwise(0)
    laid = laid.running(island=changed)
    return laid.df.groupBy(*laid.keys, "island").agg(
        F.first(answer).alias("answer"), F.min(t).alias("since_t"), F.max(t).alias("last_t"),
        F.min("frame_idx").alias("evidence_frame"), F.count("*").alias("confirmations"),
    ).withColumn("held_for_s", F.col("last_t") - F.col("since_t"))


def event_masks(laid: Laid, response: int, margin: int, warmup: int, state: str = "state_id") -> Laid:
    """Event = within ``response`` rows after a change; quiet = outside the change's wider reach."""
    laid = laid.lag(_p=state)
    change = F.when(F.col(state) != F.col("_p"), F.col("frame_idx"))
    laid = laid.last(_since=change)
    nxt = next_value(laid, change, "_next")
    since = F.col("frame_idx") - F.col("_since")
    until = F.col("_next") - F.col("frame_idx")
    return nxt.transform(
        lambda d: d.withColumns({
            "is_event": F.coalesce(since < response, F.lit(False)),
            "is_quiet": (F.col("frame_idx") >= warmup)
            & F.coalesce(since >= response + margin, F.lit(True))
            & F.coalesce(until > margin, F.lit(True)),
        }).drop("_p", "_since", "_next")
    )


def next_value(laid: Laid, value: Column, out: str) -> Laid:
    """First non-null ``value`` at or after the row.

    Read backwards, because a frame that reaches to the end is evaluated anew for every row.
    """
    back = [F.col(c).desc() for c in laid.order]
    w = Window.partitionBy(*laid.parts).orderBy(*back).rowsBetween(Window.unboundedPreceding, 0)
    if not laid.split:
        return laid.transform(lambda d: d.withColumn(out, F.last(value, True).over(w)))
    key = F.struct(*laid.order)
    heads = (
        laid.df.filter(F.col("_chunk") >= 0).groupBy(*laid.parts)
        .agg(F.min_by(value, F.when(value.isNotNull(), key)).alias("_v"))
    )
    after = Window.partitionBy(*laid.keys).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*laid.parts, F.last("_v", True).over(after).alias("_later"))
    df = join_on(laid.df, cut_lineage(heads), laid.parts, "left")
    return laid.with_df(
        df.withColumn(out, F.coalesce(F.last(value, True).over(w), F.col("_later"))).drop("_later")
    )


def peak_after(laid: Laid, value: str, rows: int, out: str = "peak_after") -> Laid:
    """Largest value in this row and the next ``rows - 1``."""
    w = laid.window()
    here = F.max(value).over(w.rowsBetween(0, rows - 1))
    if not laid.split:
        return laid.transform(lambda d: d.withColumn(out, here))
    laid = laid.head_of_next("_head", F.col(value).cast("double"), rows)
    missing = F.lit(rows - 1) - F.count("*").over(w.rowsBetween(1, rows - 1))
    return laid.transform(
        lambda d: d.withColumn("_here", here).withColumn("_missing", missing.cast("int"))
        .withColumn(out, F.greatest("_here", F.array_max(F.slice(F.coalesce("_head", F.array().cast("array<double>")), F.lit(1), F.col("_missing")))))
        .drop("_head", "_here", "_missing")
    )


def rolling_mean(laid: Laid, value: str, dt: str, out: str = "smooth") -> DataFrame:
    """Mean over the last n rows, n = round(1 / median spacing); full windows only.

    n differs per series, so the window is taken as a difference of two running sums found by row
    number, an evenly spread equi-join.
    """
    from streamlens.operators.quantiles import quantiles

    laid = laid.row_number("_rn").running(_sum=F.col(value).cast("double"))
    gaps = laid.lag(_pt=dt).df.select(*laid.keys, (F.col(dt) - F.col("_pt")).alias("_gap")).filter("_gap is not null")
    med = quantiles(gaps, laid.keys, "_gap", [0.5], within=laid)
    n = F.greatest(F.lit(1), F.round(1.0 / F.greatest(F.lit(1e-6), F.col("q_0")))).cast("long")
    spans = med.select(*laid.keys, n.alias("n_rows"))
    df = join_on(laid.df, spans, laid.keys)
    earlier = df.select(*laid.keys, (F.col("_rn") + F.col("n_rows")).alias("_rn"), F.col("_sum").alias("_old"))
    df = join_on(df, earlier, [*laid.keys, "_rn"], "left").filter(F.col("_rn") + 1 >= F.col("n_rows"))
    return df.withColumn(out, (F.col("_sum") - F.coalesce("_old", F.lit(0.0))) / F.col("n_rows")).drop("_rn", "_sum", "_old", "_chunk")


@dataclass
class RunningQuantile(Kernel):
    """Quantile of everything seen so far; NULL below ``min_samples`` values.

    Carried between batches as a value histogram, whose size is the number of distinct values.
    """

    column: str
    q: float = 0.95
    min_samples: int = 3

    def __post_init__(self):
        self.columns = ["frame_idx", self.column]
        self.schema = "frame_idx long, running_q double"

    def start(self):
        return {"v": [], "n": []}

    def step(self, state, pdf):
        new = pdf[self.column].to_numpy(dtype=np.float64)
        seen = _Ranked(np.array(state["v"], float), np.array(state["n"], np.int64))
        q = []
        for x in new.tolist():
            if x == x:
                seen.add(x)
            q.append(seen.quantile(self.q) if len(seen) >= self.min_samples else None)
        out = pd.DataFrame({"frame_idx": pdf["frame_idx"].to_numpy(), "running_q": q})
        v, n = seen.histogram()
        return {"v": v.tolist(), "n": n.tolist()}, out


class _Ranked:
    """Order statistics of values that come one by one, on top of a histogram that stays as it is: an element is found by a
    binary search over both, so a batch costs its own rows times a logarithm, whatever came before."""

    def __init__(self, v: np.ndarray, n: np.ndarray) -> None:
        self.v, self.n, self.upto = v, n, np.cumsum(n)
        self.before = int(self.upto[-1]) if len(n) else 0
        self.new: list[float] = []

    def __len__(self) -> int:
        return self.before + len(self.new)

    def add(self, x: float) -> None:
        bisect.insort(self.new, x)

    def _old(self, i: int) -> float:
        return float(self.v[np.searchsorted(self.upto, i, "right")])

    def at(self, i: int) -> float:
        lo, hi = max(0, i + 1 - self.before), min(len(self.new), i + 1)
        while lo < hi:  # how many of the first i + 1 are new
            mid = (lo + hi) // 2
            if self.new[mid] < self._old(i - mid):
                lo = mid + 1
            else:
                hi = mid
        return max(([self.new[lo - 1]] if lo else []) + ([self._old(i - lo)] if i >= lo else []))

    def quantile(self, q: float) -> float:
        place = q * (len(self) - 1)
        i = int(place)
        low = self.at(i)
        return low if place == i else low + (place - i) * (self.at(i + 1) - low)

    def histogram(self) -> tuple[np.ndarray, np.ndarray]:
        v, back = np.unique(np.concatenate([self.v, self.new]), return_inverse=True)
        return v, np.bincount(back, weights=np.concatenate([self.n, np.ones(len(self.new))]), minlength=len(v)).astype(np.int64)


def running_rate(laid: Laid, fired: Column, t: str, per_s: float = 60.0) -> Laid:
    """Calls so far per minute of elapsed stream time; NULL while no time has passed."""
    laid = laid.running(n_calls=F.when(fired, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    elapsed = (F.col(t) - F.col("_start")) / F.lit(per_s)
    return first_value(laid, t, "_start").transform(
        lambda d: d.withColumn("calls_per_min", F.try_divide(F.col("n_calls"), elapsed)).drop("_start")
    )


def relative_time(laid: Laid, t: str, out: str = "t_rel") -> Laid:
    """Seconds since the first row of the key."""
    return first_value(laid, t, "_start").transform(
        lambda d: d.withColumn(out, F.col(t) - F.col("_start")).drop("_start")
    )


def first_value(laid: Laid, value: str, out: str) -> Laid:
    """Value of the key's first row on every row."""
    w = laid.so_far()
    if not laid.split:
        return laid.transform(lambda d: d.withColumn(out, F.first(value).over(w)))
    first = laid.df.groupBy(*laid.keys).agg(F.min_by(value, F.struct(*laid.order)).alias("_fv"))
    # One row per key; joined on the chunked parts so a large key stays spread.
    parts = laid.df.select(*laid.parts).distinct()
    per_part = join_on(parts, first, laid.keys) if laid.keys else parts.crossJoin(first)
    return laid.with_df(join_on(laid.df, cut_lineage(per_part), laid.parts, "left").withColumnRenamed("_fv", out))
