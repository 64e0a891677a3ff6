"""Policy sweeps: score every policy of a grid in the pass that runs it.

The kernel keeps sums per (stream, chunk, policy), so the trace is shuffled once on the stream and
what leaves the pass is a few numbers per stream and policy. Sums of the chunks of one stream add up;
only a transition that is still waiting for its call at the end of a chunk needs the later chunks, and
those leftovers are one small array per chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamlens.functions.text import content_words
from streamlens.operators.fold import fold
from streamlens.operators.layout import CHUNK, Laid, join_on
from streamlens.operators.policies import SIGNALS, Bank, Policy, Trigger


#: Content words of an answer in order, as one text: what the kernel compares.
BAG = "_bag"


def with_bags(laid: Laid) -> Laid:
    """Add the content words of ``answer``, found in the JVM, as sorted text."""
    return laid.transform(lambda d: d.withColumn(BAG, F.concat_ws(" ", F.sort_array(content_words(F.col("answer"))))))


def _bag_f1(cache: dict, a: str | None, b: str | None) -> float:
    """F1 of two sorted word texts, 2 * shared / (words of a + words of b), remembered per pair; two empty ones agree."""
    hit = cache.get((a, b))
    if hit is None:
        if len(cache) > 200_000:
            cache.clear()
        x, y = (np.array((t or "").split(), dtype=object) for t in (a, b))
        words, code = np.unique(np.concatenate([x, y]), return_inverse=True)
        size = len(words)
        shared = np.minimum(np.bincount(code[: len(x)], minlength=size), np.bincount(code[len(x):], minlength=size)).sum() if size else 0
        hit = cache[(a, b)] = 2.0 * float(shared) / (len(x) + len(y)) if size else 1.0
    return hit


SUMS = ["n_rows", "n_scored", "n_valid", "f1_sum", "n_calls", "n_false", "n_justified", "stale_n",
        "stale_sum", "n_events", "n_covered", "delay_sum"]


@dataclass
class SweepScore(Trigger):
    fps: float = 30.0
    warmup: int = 15
    with_text: bool = False
    leftovers: bool = False  # also report what later chunks of a split stream have to settle

    def __post_init__(self):
        super().__post_init__()
        self.columns = ["frame_idx", "t", *SIGNALS, "state_id"] + ([BAG] if self.with_text else [])
        self.schema = (
            "pid int, " + ", ".join(f"{c} double" for c in SUMS) + (", stale array<struct<lag:long,n:long>>" if self.with_text else "")
            + (", waiting array<struct<state:long,n:double,total:double>>, first_call array<struct<state:long,frame:double>>"
               if self.leftovers else "")
        )
        self._f1 = {}
        self._bank = Bank(self.policies)

    def start(self):
        return {"p": [{} for _ in self.policies], "held": [None] * len(self.policies), "prev": None, "acc": None}

    def chunk_entry(self, state):
        return {"p": state["p"], "held": state["held"], "prev": state["prev"], "acc": None}

    def through(self, probe, run, entry):
        cold = {"entry": self.start(), "exit": probe["exit"]}
        p, held, sure = [], [], True
        for i, before in enumerate(entry["held"]):
            carry, known, idle = self._through_one(i, probe, run, entry["p"][i])
            # the call that is held is that of a run which ends in the same one; in no call, the one before
            same = [x for x in (run, cold) if x and x["entry"]["p"][i] == entry["p"][i]]
            alike = [x for x in (run, cold) if x and x["exit"]["p"][i].get("t") == carry.get("t")]
            if idle:
                after = before
            elif same:
                after = same[0]["exit"]["held"][i] if same[0]["exit"]["held"][i] != same[0]["entry"]["held"][i] else before
            else:
                after = (alike or [run or cold])[0]["exit"]["held"][i]
                known = known and bool(alike) and self.policies[i].gap_only
            p.append(carry)
            held.append(after)
            sure = sure and known
        return {"p": p, "held": held, "prev": probe["exit"]["prev"], "acc": None}, sure

    def step(self, state, pdf):
        block = self.block(pdf)
        frame, st = block["frame_idx"], pdf["state_id"].to_numpy(dtype=np.int64)
        n, size = len(frame), len(self.policies)
        fired, carries = self._bank.fire(block, state["p"])
        none = np.iinfo(np.int64).min
        held = state["held"]
        h0_state = np.array([none if h is None else h[1] for h in held], dtype=np.int64)
        h0_frame = np.array([0 if h is None else h[0] for h in held], dtype=np.int64)
        pos = np.where(fired, np.arange(n)[:, None], -1)
        np.maximum.accumulate(pos, axis=0, out=pos)
        here = pos >= 0
        h_state = np.where(here, st[pos], h0_state)
        graded = (frame >= self.warmup)[:, None]
        known = (h_state != none) & graded
        now = st[:, None]
        before = np.vstack([h0_state[None, :], h_state[:-1]])  # state of the call before the row
        labelled = fired & (before != none)
        lag = np.where(known, frame[:, None] - np.where(here, frame[pos], h0_frame), 0)

        acc = state["acc"] or {"sum": [[0.0] * size for _ in SUMS], "wait": {}, "first": {}, "lags": [{} for _ in range(size)]}
        sums = {
            "n_rows": np.full(size, n), "n_scored": np.full(size, graded.sum()), "n_valid": (known & (h_state == now)).sum(0),
            "f1_sum": self._text_sum(pdf[BAG].to_numpy(), pos, held, known) if self.with_text else np.zeros(size),
            "n_calls": fired.sum(0), "n_false": (labelled & (before == now)).sum(0), "n_justified": (labelled & (before != now)).sum(0),
            "stale_n": known.sum(0), "stale_sum": lag.sum(0) * (1000.0 / self.fps),
        }
        if self.with_text:
            self._count_lags(acc["lags"], lag, known)
        prev = np.concatenate([[st[0] if state["prev"] is None else state["prev"]], st[:-1]])
        moved = st != prev
        sums["n_events"] = np.full(size, moved.sum())
        sums["n_covered"], sums["delay_sum"] = self._cover(acc, frame, st, moved, fired)
        acc["sum"] = [(np.array(a) + sums[c]).tolist() for a, c in zip(acc["sum"], SUMS)]
        last = pos[-1]
        helds = [
            held[i] if last[i] < 0 else [int(frame[last[i]]), int(st[last[i]]), pdf[BAG].iloc[last[i]] if self.with_text else None]
            for i in range(size)
        ]
        return {"p": carries, "held": helds, "prev": int(st[-1]), "acc": acc}, None

    def _text_sum(self, answers, pos, held, known) -> np.ndarray:
        codes, texts = pd.factorize(answers)
        texts = [*texts, *[h[2] if h else None for h in held]]
        k = len(texts)
        start = k - len(held) + np.arange(len(held))  # code of the answer held when the block began
        pairs = np.where(pos >= 0, codes[pos], start) * k + codes[:, None]
        distinct, where = np.unique(pairs[known], return_inverse=True)
        f1 = np.array([_bag_f1(self._f1, texts[x // k], texts[x % k]) for x in distinct.tolist()])
        out = np.zeros(pairs.shape)
        if len(distinct):
            out[known] = f1[where]
        return out.sum(0)

    @staticmethod
    def _count_lags(lags, lag, known) -> None:
        """Add to every policy's histogram of the frames by which the held answer is old."""
        for i, counts in enumerate(lags):
            for v, n in zip(*(x.tolist() for x in np.unique(lag[known[:, i], i], return_counts=True))):
                counts[str(v)] = counts.get(str(v), 0) + n

    def _cover(self, acc, frame, st, moved, fired):
        """A transition is covered by the first later-or-equal call made in its new state.

        Returns events covered and frames waited for them, per policy; events still waiting stay in
        ``acc["wait"]`` and the first call of the chunk per state in ``acc["first"]``.
        """
        size = fired.shape[1]
        covered, waited = np.zeros(size), np.zeros(size)
        for s in np.unique(st):
            rows = np.flatnonzero(st == s)
            at = np.where(fired[rows], frame[rows][:, None].astype(float), np.inf)
            nxt = np.minimum.accumulate(at[::-1], axis=0)[::-1]  # next call at or after each of the rows
            called = np.isfinite(nxt[0])
            key = str(int(s))
            first = acc["first"].setdefault(key, [None] * size)
            for i in np.flatnonzero(called):
                if first[i] is None:
                    first[i] = float(nxt[0, i])
            if key in acc["wait"]:
                n, total = (np.array(x) for x in acc["wait"][key])
                done = called & (n > 0)
                covered += np.where(done, n, 0)
                waited += np.where(done, n * np.where(done, nxt[0], 0) - total, 0)
                acc["wait"][key] = [np.where(called, 0, n).tolist(), np.where(called, 0, total).tolist()]
            mine = moved[rows]
            if mine.any():
                hit, f = np.isfinite(nxt[mine]), frame[rows][mine].astype(float)[:, None]
                covered += hit.sum(0)
                waited += np.where(hit, np.where(hit, nxt[mine], 0) - f, 0).sum(0)
                if not hit.all():
                    n, total = acc["wait"].get(key, [[0.0] * size, [0.0] * size])
                    acc["wait"][key] = [(np.array(n) + (~hit).sum(0)).tolist(), (np.array(total) + np.where(hit, 0, f).sum(0)).tolist()]
        return covered, waited

    def finish(self, state):
        acc = state["acc"]
        if acc is None:
            return None
        size = range(len(self.policies))
        out = pd.DataFrame({"pid": list(size), **dict(zip(SUMS, acc["sum"]))})
        if self.with_text:
            out["stale"] = [[{"lag": int(k), "n": n} for k, n in counts.items()] for counts in acc["lags"]]
        if self.leftovers:
            out["waiting"] = [
                [{"state": int(k), "n": n[i], "total": t[i]} for k, (n, t) in acc["wait"].items() if n[i] > 0] for i in size]
            out["first_call"] = [
                [{"state": int(k), "frame": v[i]} for k, v in acc["first"].items() if v[i] is not None] for i in size]
        return out


def _policy_rows(spark, policies: list[Policy]) -> DataFrame:
    return spark.createDataFrame(
        [(i, p.kind, p.name, float(p.point)) for i, p in enumerate(policies)],
        "pid int, kind string, policy string, point double",
    )


def sweep(laid: Laid, policies: list[Policy], fps: float = 30.0, warmup: int = 15,
          with_text: bool = False) -> DataFrame:
    """Scores per (stream, policy, point). ``laid`` needs the trace columns. ``with_text``: also how far the held answers agree
    with the row's own (``accuracy``, otherwise NULL) and the 95th percentile of staleness."""
    kernel = SweepScore(policies, fps=fps, warmup=warmup, with_text=with_text)
    keys = list(laid.keys)
    spark = laid.df.sparkSession
    if with_text:
        laid = with_bags(laid)
    if laid.split:
        # Keep the chunk in the output: leftovers of a chunk are settled by the chunks after it.
        marked = laid.with_df(laid.df.withColumn("_at", F.col(CHUNK)))
        parts = fold(marked, _Marked(kernel))
        sums = _summed(parts, keys, fps) if with_text else parts.groupBy(*keys, "pid").agg(*[F.sum(c).alias(c) for c in SUMS])
        calls = parts.select(*keys, "pid", "_at", F.explode("first_call").alias("x")).select(
            *keys, "pid", F.col("x.state").alias("state"), F.col("_at").alias("_from"), F.col("x.frame").alias("frame"))
        waits = parts.select(*keys, "pid", "_at", F.explode("waiting").alias("x")).select(
            *keys, "pid", F.col("x.state").alias("state"), "_at", F.col("x.n").alias("n"), F.col("x.total").alias("total"))
        # As-of forward on (stream, policy, state): rows here are chunks x states, not trace rows.
        both = waits.withColumn("_o", F.col("_at") + 1).withColumn("frame", F.lit(None).cast("double")).unionByName(
            calls.withColumn("_o", F.col("_from")), allowMissingColumns=True)
        w = Window.partitionBy(*keys, "pid", "state").orderBy(F.col("_o").desc(), F.col("frame").isNull()).rowsBetween(
            Window.unboundedPreceding, 0)
        late = (
            both.withColumn("_f", F.last("frame", ignorenulls=True).over(w)).filter("n is not null and _f is not null")
            .groupBy(*keys, "pid").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("_f") - F.col("total")).alias("_d"))
        )
        sums = join_on(sums, late, [*keys, "pid"], "left").withColumns({
            "n_covered": F.col("n_covered") + F.coalesce("_n", F.lit(0.0)),
            "delay_sum": F.col("delay_sum") + F.coalesce("_d", F.lit(0.0)),
        })
    else:
        sums = fold(laid, kernel)
        if with_text:
            sums = _summed(sums, keys, fps)
    return _finish(sums.join(F.broadcast(_policy_rows(spark, policies)), "pid"), keys, fps, with_text)


def _summed(parts: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """Sums of the chunks of a stream and the exact 95th percentile of staleness, from the chunks' histograms."""
    long = parts.select(*keys, "pid", *SUMS, F.posexplode_outer("stale").alias("_pos", "_x"))
    once = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    p95 = F.percentile(F.col("_x.lag") * F.lit(1000.0 / fps), F.lit(0.95), F.coalesce(F.col("_x.n"), F.lit(0).cast("long")))
    return long.groupBy(*keys, "pid").agg(*[F.sum(F.when(once, F.col(c))).alias(c) for c in SUMS], p95.alias("stale_p95"))


class _Marked(SweepScore):
    """The sweep kernel with the chunk number among its outputs."""

    def __init__(self, kernel: SweepScore) -> None:
        super().__init__(kernel.policies, fps=kernel.fps, warmup=kernel.warmup, with_text=kernel.with_text, leftovers=True)
        self.columns = [*self.columns, "_at"]
        self.schema = self.schema + ", _at long"

    def start(self):
        return {**super().start(), "at": None}

    def step(self, state, pdf):
        at = int(pdf["_at"].iloc[0])
        state, out = super().step(state, pdf)
        return {**state, "at": at}, out

    def finish(self, state):
        out = super().finish(state)
        if out is not None:
            out["_at"] = state["at"]
        return out


def _finish(sums: DataFrame, keys: list[str], fps: float, with_text: bool) -> DataFrame:
    c = F.col
    minutes = c("n_rows") / F.lit(fps) / 60.0
    return sums.select(
        *keys, "kind", "policy", "point",
        c("n_rows").cast("long").alias("n_rows"), c("n_calls").cast("long").alias("n_calls"),
        F.try_divide(c("n_calls"), minutes).alias("calls_per_min"),
        F.try_divide(c("n_calls"), c("n_rows")).alias("call_fraction"),
        F.try_divide(c("n_valid"), c("n_scored")).alias("validity"),
        (F.try_divide(c("f1_sum"), c("n_scored")) if with_text else F.lit(None).cast("double")).alias("accuracy"),
        F.try_divide(c("stale_sum"), c("stale_n")).alias("staleness_ms_mean"),
        *([c("stale_p95").alias("staleness_ms_p95")] if with_text else []),
        c("n_false").cast("long").alias("false_triggers"),
        c("n_justified").cast("long").alias("justified_calls"),
        F.try_divide(c("n_false"), c("n_false") + c("n_justified")).alias("false_trigger_rate"),
        (c("n_events") - c("n_covered")).cast("long").alias("missed_events"),
        c("n_events").cast("long").alias("total_events"),
        F.try_divide(c("n_covered"), c("n_events")).alias("event_recall"),
        (F.try_divide(c("delay_sum"), c("n_covered")) / F.lit(fps) * 1000.0).alias("detection_delay_ms_mean"),
    )
