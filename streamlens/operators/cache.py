"""Semantic cache: reuse an earlier answer whose key looks alike and is not too old."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlens.functions import vec
from streamlens.operators.fold import Kernel, fold
from streamlens.operators.layout import Laid, join_on
from streamlens.operators.nearest import best_earlier
from streamlens.operators.policies import Policy, Trigger
from streamlens.operators.quantiles import auc, quantiles, quantiles_where


class Store:
    """At most ``size`` entries of one stream, oldest first: their keys as rows of one matrix, the rest as a table."""

    def __init__(self, threshold: float, size: int, max_age: float, saved: dict | None = None) -> None:
        self.threshold, self.size, self.max_age = threshold, size, max_age
        self.keys = np.array(saved["keys"], dtype=np.float64) if saved and saved["keys"] else np.empty((0, 0))
        self.info = np.array([tuple(x) for x in saved["info"]] if saved else [], dtype=[("frame", "i8"), ("state", "i8"), ("t", "f8"), ("hits", "i8")])
        self.evicted = 0

    def __len__(self) -> int:
        return len(self.info)

    def saved(self) -> dict:
        return {"keys": self.keys.tolist(), "info": [list(x) for x in self.info.tolist()]}

    def entry(self, i: int) -> tuple[int, int, float]:
        frame, state, t, _ = self.info[i].tolist()
        return frame, state, t

    def lookup(self, e: np.ndarray, t: float) -> tuple[int | None, float | None]:
        """(entry, best similarity). Ties go to the earliest entry."""
        if not len(self):
            return None, None
        sims = self.keys @ e
        usable = np.flatnonzero((sims >= self.threshold) & (t - self.info["t"] <= self.max_age))
        if not len(usable):
            return None, float(sims.max())
        i = int(usable[np.argmax(sims[usable])])
        self.info["hits"][i] += 1
        return i, float(sims[i])

    def add(self, e: np.ndarray, frame: int, state: int, t: float) -> None:
        """Append an entry; of one too many the least used goes, of equals the oldest. That may be the new one itself."""
        self.keys = np.vstack([self.keys.reshape(-1, len(e)), e])
        self.info = np.append(self.info, np.array([(frame, state, t, 0)], dtype=self.info.dtype))
        if len(self) > self.size:
            worst = np.lexsort((self.info["t"], self.info["hits"]))[0]
            self.keys, self.info = np.delete(self.keys, worst, axis=0), np.delete(self.info, worst)
            self.evicted += 1


@dataclass
class CacheRun(Kernel):
    """A policy followed by the cache, once per threshold (None = no cache). One row per trigger."""

    policy: Policy
    thresholds: list
    size: int = 64
    max_age: float = 30.0

    def __post_init__(self):
        self._trigger = Trigger([self.policy])
        self.columns = [*self._trigger.columns, "embedding", "state_id"]
        self.schema = (
            "cache_threshold double, frame_idx long, t double, state_id long, hit boolean, similarity double,"
            " evidence_frame long, evidence_state long, evidence_t double, evictions long, entries long"
        )

    def start(self):
        # A hit restarts the gap just as a call does, so the triggers do not depend on the cache.
        return {"trigger": self._trigger.start(), "stores": [None for _ in self.thresholds]}

    def step(self, state, pdf):
        trigger, fired = self._trigger.step(state["trigger"], pdf)
        stores = state["stores"]
        if fired is None:
            return {"trigger": trigger, "stores": stores}, None
        at = pdf.set_index("frame_idx").loc[fired["frame_idx"]]
        emb = np.stack([np.asarray(x, dtype=np.float64) for x in at["embedding"]])
        t, st = at["t"].to_numpy(float), at["state_id"].to_numpy()
        frames = fired["frame_idx"].to_numpy()
        rows, saved = [], []
        for thr, was in zip(self.thresholds, stores):
            store = Store(np.inf if thr is None else thr, self.size, self.max_age, was)
            for i in range(len(frames)):
                evicted = store.evicted
                hit, sim = (None, None) if thr is None else store.lookup(emb[i], t[i])
                if hit is None:
                    ev = (int(frames[i]), int(st[i]), float(t[i]))
                    if thr is not None:
                        store.add(emb[i], *ev)
                else:
                    ev = store.entry(hit)
                rows.append((thr, int(frames[i]), float(t[i]), int(st[i]), hit is not None, sim, *ev,
                             store.evicted - evicted, len(store)))
            saved.append(store.saved())
        names = [
            "cache_threshold", "frame_idx", "t", "state_id", "hit", "similarity", "evidence_frame",
            "evidence_state", "evidence_t", "evictions", "entries"]
        out = pd.DataFrame(rows, columns=names)
        return {"trigger": trigger, "stores": saved}, out


def lookups(laid: Laid, policy: Policy, thresholds: list, size: int = 64, max_age: float = 30.0) -> DataFrame:
    """Every trigger of ``policy`` with what the cache made of it, per cache threshold."""
    return fold(laid, CacheRun(policy, thresholds, size, max_age))


def replay(laid: Laid, served: DataFrame, thresholds: list, fps: float = 30.0, warmup: int = 15) -> DataFrame:
    """Score each cache threshold: calls paid, hits, false hits, validity, staleness.

    The triggers of all thresholds meet their row as one small map, so the trace is joined and carried
    forward once and is multiplied by the thresholds only inside the final partial aggregate.
    """
    keys, n = list(laid.keys), len(thresholds)
    thr = laid.df.sparkSession.createDataFrame(list(enumerate(thresholds)), "tid int, cache_threshold double")
    trig = served.join(F.broadcast(thr.withColumnRenamed("cache_threshold", "_thr")),
                       F.col("cache_threshold").eqNullSafe(F.col("_thr"))).drop("_thr")
    what = F.struct("evidence_frame", "evidence_state", "hit", "evictions")
    per_row = trig.groupBy(*keys, "frame_idx").agg(F.map_from_entries(F.collect_list(F.struct("tid", what.alias("e")))).alias("_m"))
    cols = dict.fromkeys([*laid.parts, *laid.order, "frame_idx", "state_id"])
    held = laid.with_df(join_on(laid.df.select(*cols), per_row, [*keys, "frame_idx"], "left"))
    held = held.last(**{f"_h{i}": F.element_at("_m", F.lit(i)) for i in range(n)})
    settings = [F.struct(F.col(f"_h{i}").alias("h"), F.element_at("_m", F.lit(i)).alias("m")) for i in range(n)]
    long = held.df.select(*keys, "frame_idx", "state_id", F.posexplode(F.array(*settings)).alias("tid", "x"))
    graded, h, m = F.col("frame_idx") >= warmup, F.col("x.h"), F.col("x.m")
    valid = F.coalesce(h["evidence_state"] == F.col("state_id"), F.lit(False)).cast("double")
    stats = long.groupBy(*keys, "tid").agg(
        F.count("*").alias("n_rows"), F.count(m).alias("n_triggers"), F.count_if(~m["hit"]).alias("n_calls"),
        F.count_if(m["hit"]).alias("n_hits"), F.count_if(m["hit"] & (m["evidence_state"] != F.col("state_id"))).alias("false_hits"),
        F.sum(m["evictions"]).alias("evictions"), F.avg(F.when(graded, valid)).alias("validity"),
        F.avg(F.when(graded, (F.col("frame_idx") - h["evidence_frame"]) / F.lit(fps) * 1000.0)).alias("staleness_ms_mean"))
    avoided = F.col("n_triggers") - F.col("n_calls")
    return stats.join(F.broadcast(thr), "tid").select(
        *keys, "cache_threshold", "n_rows", "n_triggers", "n_calls", "n_hits", "false_hits", "evictions",
        avoided.alias("calls_avoided"),
        F.try_divide(F.lit(100.0) * avoided, F.col("n_triggers")).alias("calls_avoided_pct"),
        F.try_divide(F.col("n_hits"), F.col("n_triggers")).alias("hit_rate"),
        F.try_divide(F.col("false_hits"), F.col("n_hits")).alias("false_hit_rate"),
        "validity", "staleness_ms_mean",
        (F.col("n_calls") / (F.col("n_rows") / F.lit(fps) / 60.0)).alias("calls_per_min"),
    )


def sweep_table(replayed: DataFrame, by: list[str]) -> DataFrame:
    return replayed.groupBy(*by).agg(
        F.count("*").alias("n_streams"), F.avg("calls_per_min").alias("calls_per_min_mean"),
        F.avg("calls_avoided_pct").alias("calls_avoided_pct_mean"), F.sum("calls_avoided").alias("calls_avoided_total"),
        F.sum("n_triggers").alias("n_triggers_total"), F.avg("hit_rate").alias("hit_rate_mean"),
        F.sum("false_hits").alias("false_hits_total"), F.avg("false_hit_rate").alias("false_hit_rate_mean"),
        F.avg("validity").alias("validity_mean"), F.avg("staleness_ms_mean").alias("staleness_ms_mean"))


def verdict(table: DataFrame, keep_pct: float = 10.0) -> DataFrame:
    """One row: keep the cache if some threshold loses no validity and saves at least ``keep_pct`` %.

    ``table`` is a sweep table; its row with a NULL threshold is the run without a cache.
    """
    base = table.filter("cache_threshold is null").agg(
        F.first("validity_mean").alias("baseline_validity"), F.first("calls_per_min_mean").alias("baseline_calls_per_min"),
        F.lit(1).alias("_one"))
    rows = table.filter("cache_threshold is not null").withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one")
    pick = F.struct(F.col("calls_avoided_pct_mean").alias("avoided"), (-F.col("cache_threshold")).alias("nthr"))
    best = rows.agg(
        F.first("baseline_validity").alias("baseline_validity"), F.first("baseline_calls_per_min").alias("baseline_calls_per_min"),
        F.max(F.when(F.col("validity_mean") >= F.col("baseline_validity") - 1e-9, pick)).alias("_safe"), F.max(pick).alias("_any"))
    rec = (
        F.when(F.col("baseline_validity").isNull(), F.lit("inconclusive"))
        .when(F.col("_safe.avoided") >= keep_pct, F.lit("keep")).otherwise(F.lit("cut"))
    )
    return best.select(
        rec.alias("recommendation"), "baseline_validity", "baseline_calls_per_min",
        (-F.col("_safe.nthr")).alias("best_lossless_threshold"), F.col("_safe.avoided").alias("best_lossless_avoided_pct"),
        (-F.col("_any.nthr")).alias("best_any_threshold"), F.col("_any.avoided").alias("best_any_avoided_pct"))


def statistics(served: DataFrame, by: list[str]) -> DataFrame:
    return served.groupBy(*by).agg(
        F.count("*").alias("n_lookups"), F.count_if("hit").alias("n_hits"),
        F.try_divide(F.count_if("hit"), F.count("*")).alias("hit_rate"),
        F.sum("evictions").alias("n_evictions"), F.max_by("entries", "frame_idx").alias("n_entries"))


# -- how good is the key ----------------------------------------------------------------------
def best_earlier_similarity(fired: Laid, block: int = 4096) -> DataFrame:
    """For every fired row the best dot product with any earlier fired row of its stream; see ``nearest.best_earlier``."""
    return best_earlier(fired, block)


def similarity_summary(best: DataFrame, keys: list[str]) -> DataFrame:
    """How alike triggers are to what came before: count, median and maximum per stream and, with NULL keys, over all."""
    def of(by: list[str]) -> DataFrame:
        head = best.groupBy(*by).agg(F.count("*").alias("n"), F.max("best_similarity").alias("max_similarity"))
        med = quantiles(best, by, "best_similarity", [0.5]).withColumnRenamed("q_0", "median_similarity")
        return join_on(head, med, by) if by else head.crossJoin(med)

    return of(keys).unionByName(of([]), allowMissingColumns=True)


#: Steps of the two draws of a pair, as parts of the stream.
STEPS = (0.6180339887498949, 0.7548776662466927)


def key_pairs(laid: Laid, draws: int = 4000) -> DataFrame:
    """``draws`` repeatable row pairs per stream with their similarity and whether the state agrees."""
    keys = list(laid.keys)
    numbered = laid.row_number("_p").df
    n = numbered.groupBy(*keys).agg(F.count("*").alias("_n"))
    k = n.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    # the k-th draw is a fraction of the stream, spread by two irrational steps: every length is covered from end to end
    pick = lambda step: F.floor((F.col("_k") * step - F.floor(F.col("_k") * step)) * F.col("_n"))
    pairs = k.select(*keys, "_k", pick(STEPS[0]).alias("_i"), pick(STEPS[1]).alias("_j")).filter("_i <> _j")
    left = numbered.select(*keys, F.col("_p").alias("_i"), F.col("embedding").alias("_a"), F.col("state_id").alias("_sa"))
    right = numbered.select(*keys, F.col("_p").alias("_j"), F.col("embedding").alias("_b"), F.col("state_id").alias("_sb"))
    return join_on(join_on(pairs, left, [*keys, "_i"]), right, [*keys, "_j"]).select(
        *keys, "_k", vec.dot(F.col("_a"), F.col("_b")).alias("similarity"), (F.col("_sa") == F.col("_sb")).alias("same_state"))


def key_quality(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Streams with both kinds of pairs: percentiles of each kind and the AUC of similarity.

    ``pairs`` are the bounded draws of ``key_pairs``, so no group is too large for one task.
    """
    small = Laid(pairs, tuple(keys), ("similarity",), False)
    a = auc(pairs, keys, "similarity", "same_state", within=small).filter("auc is not null")
    same = F.col("same_state")
    q = quantiles_where(pairs, keys, "similarity", {
        "same_median": (same, 0.5), "same_p10": (same, 0.1), "diff_median": (~same, 0.5), "diff_p90": (~same, 0.9)}, within=small)
    return join_on(a, q, keys).drop("n_pos", "n_neg")
