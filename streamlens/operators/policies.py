"""Trigger policies: which rows of a stream are worth an expensive call, under a rate limit.

Each policy works on a block of rows and a small carry, and returns the positions that fire. All
policies of a grid run over one pass of the stream, so a sweep shuffles the trace once, not once per
policy. A user policy subclasses ``Policy`` and implements ``decide`` for one row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd

from streamlens.operators.fold import Kernel

# The knob grid of each policy kind.
OPERATING_POINTS = {
    "fixed_interval": [0.0, 0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 10.0],
    "motion_threshold": [0.0005, 0.001, 0.002, 0.004, 0.008, 0.015, 0.03, 0.06, 0.12],
    "embedding_novelty": [0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.35, 0.6],
    "information_gain": [0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.35],
    "adaptive_novelty": [0.80, 0.90, 0.95, 0.97, 0.98, 0.99, 0.995, 0.998, 0.999],
    "learned": [0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.88, 0.95],
}
LEARNED_FEATURES = ("novelty", "scene_change", "motion", "since_last_call", "novelty_delta")

SIGNALS = ["motion", "novelty", "scene_change"]


@dataclass
class Context:
    """What a policy may see of a row: the present, and its own last call."""

    frame_idx: int
    t: float
    motion: float
    novelty: float
    scene_change: float
    t_last_call: float | None
    novelty_at_last_call: float
    n_calls: int

    @property
    def since_last_call(self) -> float:
        return math.inf if self.t_last_call is None else self.t - self.t_last_call


class Policy:
    """One policy at one operating point."""

    kind = "policy"
    point = 0.0
    gap_only = False  # True when the carry is only "time of the last call"

    @property
    def name(self) -> str:
        return self.kind

    def describe(self) -> dict[str, Any]:
        return {"policy": self.name, "point": self.point}

    def decide(self, ctx: Context) -> tuple[bool, float]:
        """(fire, score) of one row."""
        raise NotImplementedError

    def outline(self, block: dict[str, np.ndarray]) -> Any:
        """What tells later whether any of these rows could fire after a call before them; None if the policy cannot tell."""
        return None

    def joined(self, outlines: list) -> Any:
        raise NotImplementedError

    def passes(self, outline: Any, carry: dict) -> bool:
        """Surely no row of the outline fires after the call in ``carry``."""
        return False

    def scan(self, block: dict[str, np.ndarray], carry: dict) -> tuple[np.ndarray, np.ndarray, dict]:
        """Fired positions, their scores and the new carry. The default asks ``decide`` row by row."""
        fired, scores = [], []
        t_last, nov, n = carry.get("t"), carry.get("v", 0.0), carry.get("n", 0)
        for i in range(len(block["t"])):
            ctx = Context(
                int(block["frame_idx"][i]), float(block["t"][i]), float(block["motion"][i]),
                float(block["novelty"][i]), float(block["scene_change"][i]), t_last, nov, n,
            )
            fire, score = self.decide(ctx)
            if fire:
                fired.append(i)
                scores.append(score)
                t_last, nov, n = ctx.t, ctx.novelty, n + 1
        return np.array(fired, dtype=np.int64), np.array(scores), {**carry, "t": t_last, "v": nov, "n": n}


def _pick_with_gap(t: np.ndarray, ok: np.ndarray, gap: float, t_last: float | None, force_first: bool):
    """Greedy selection: the next allowed row at least ``gap`` after the last one taken."""
    picks: list[int] = []
    cand = np.flatnonzero(ok)
    ct = t[cand]
    if t_last is None:
        if len(t) == 0:
            return picks, t_last
        start = 0 if force_first else (int(cand[0]) if len(cand) else None)
        if start is None:
            return picks, t_last
        picks.append(start)
        t_last = float(t[start])
    if gap <= 0:
        lo = np.searchsorted(cand, picks[-1] + 1) if picks else 0
        rest = cand[lo:]
        picks.extend(rest.tolist())
        return picks, float(t[picks[-1]]) if picks else t_last
    pos = int(np.searchsorted(cand, picks[-1] + 1)) if picks else 0
    while pos < len(cand):
        j = max(pos, int(np.searchsorted(ct, t_last + gap, "left")))
        while j > pos and ct[j - 1] - t_last >= gap:  # subtraction decides, as for a single row
            j -= 1
        while j < len(cand) and ct[j] - t_last < gap:
            j += 1
        if j >= len(cand):
            break
        picks.append(int(cand[j]))
        t_last = float(ct[j])
        pos = j + 1
    return picks, t_last


@dataclass
class FixedInterval(Policy):
    period_s: float
    kind = "fixed_interval"
    gap_only = True

    @property
    def point(self) -> float:
        return self.period_s

    @property
    def name(self) -> str:
        if self.period_s <= 0:
            return "oracle"
        hz = 1.0 / self.period_s
        return f"fixed_{hz:g}hz" if hz >= 1 else f"fixed_{self.period_s:g}s"

    @property
    def gap(self) -> float:
        return max(0.0, self.period_s)

    def allowed(self, block) -> np.ndarray:
        return np.ones(len(block["t"]), bool)

    def decide(self, ctx):
        return self.period_s <= 0 or ctx.since_last_call >= self.period_s, 1.0

    def scan(self, block, carry):
        picks, t_last = _pick_with_gap(block["t"], self.allowed(block), self.gap, carry.get("t"), True)
        picks = np.array(picks, dtype=np.int64)
        return picks, np.ones(len(picks)), {"t": t_last}


class SignalThreshold(Policy):
    """Fires when a signal reaches a cut-point; ``motion_threshold`` and ``embedding_novelty``."""

    gap_only = True

    def __init__(self, kind: str, signal: str, threshold: float, min_gap_s: float = 0.3) -> None:
        self.kind, self.signal = kind, signal
        self.threshold, self.min_gap_s = float(threshold), float(min_gap_s)

    @property
    def point(self) -> float:
        return self.threshold

    @property
    def gap(self) -> float:
        return self.min_gap_s

    def allowed(self, block):
        return block[self.signal] >= self.threshold

    def decide(self, ctx):
        v = getattr(ctx, self.signal)
        if ctx.t_last_call is None:
            return True, v
        return ctx.since_last_call >= self.min_gap_s and v >= self.threshold, v

    def scan(self, block, carry):
        picks, t_last = _pick_with_gap(block["t"], self.allowed(block), self.gap, carry.get("t"), True)
        picks = np.array(picks, dtype=np.int64)
        return picks, block[self.signal][picks], {"t": t_last}


class _Scored(Policy):
    """Fires when a score of (row, last call) reaches the threshold; scanned block-wise."""

    def score(self, block, sl: slice, t_last: float, v_last: float) -> np.ndarray:
        raise NotImplementedError

    def scan(self, block, carry):
        t, v = block["t"], block["novelty"]
        n, i = len(t), 0
        t_last, v_last = carry.get("t"), carry.get("v", 0.0)
        picks, scores = [], []
        if t_last is None and n:
            picks.append(0)
            scores.append(1.0)
            t_last, v_last, i = float(t[0]), float(v[0]), 1
        width = 32
        while i < n:
            sl = slice(i, min(n, i + width))
            s = self.score(block, sl, t_last, v_last)
            hit = np.flatnonzero((t[sl] - t_last >= self.min_gap_s) & (s >= self.threshold))
            if len(hit):
                j = i + int(hit[0])
                picks.append(j)
                scores.append(float(s[hit[0]]))
                t_last, v_last, i, width = float(t[j]), float(v[j]), j + 1, 32
            else:
                i, width = sl.stop, min(width * 2, 8192)
        return np.array(picks, dtype=np.int64), np.array(scores), {"t": t_last, "v": v_last}


#: Points that describe a chunk to a policy at most.
OUTLINE = 4096


@dataclass
class InformationGain(_Scored):
    threshold: float
    half_life_s: float = 3.0
    min_gap_s: float = 0.3
    kind = "information_gain"

    @property
    def point(self) -> float:
        return self.threshold

    def score(self, block, sl, t_last, v_last):
        stale = 1.0 - np.power(0.5, (block["t"][sl] - t_last) / self.half_life_s)
        return np.maximum(0.0, block["novelty"][sl] - v_last) * (0.5 + 0.5 * stale)

    # The gain grows with novelty and age, so of two rows the later one with no less novelty fires if the other does: the rows
    # above all later ones stand for the chunk.
    def outline(self, block):
        return self.joined([[block["t"].tolist(), block["novelty"].tolist()]])

    def joined(self, outlines):
        t, v = (np.concatenate([np.array(o[k], float) for o in outlines]) for k in (0, 1))
        later = np.concatenate([np.maximum.accumulate(v[::-1])[::-1][1:], [-np.inf]]) if len(v) else v
        top = ~(v <= later)  # a NaN stays, and never passes
        return _thinned([t[top], v[top]], [np.maximum, np.maximum])

    def passes(self, outline, carry):
        t, v = (np.array(x, float) for x in outline)
        age = t - carry["t"]
        most = np.maximum(0.0, v - carry["v"]) * (1.0 - 0.5 * np.power(0.5, age / self.half_life_s))
        return bool(np.all((age < self.min_gap_s) | (most < self.threshold * (1 - 1e-9))))


@dataclass
class Learned(_Scored):
    weights: list[float]
    bias: float
    threshold: float = 0.5
    min_gap_s: float = 0.3
    kind = "learned"

    @property
    def point(self) -> float:
        return self.threshold

    def score(self, block, sl, t_last, v_last):
        w = self.weights
        nov = block["novelty"][sl]
        z = (
            w[0] * nov + w[1] * block["scene_change"][sl] + w[2] * block["motion"][sl]
            + w[3] * (np.minimum(block["t"][sl] - t_last, 30.0) / 10.0)
            + w[4] * np.maximum(0.0, nov - v_last) + self.bias
        )
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))

    # Neighbouring rows are bounded together: their largest part of z that no call changes, their largest novelty, their times.
    def outline(self, block):
        w = self.weights
        base = w[0] * block["novelty"] + w[1] * block["scene_change"] + w[2] * block["motion"] + self.bias
        at = np.arange(0, len(base), 16)
        if not len(at):
            return [[], [], [], []]
        return [np.maximum.reduceat(base, at).tolist(), np.maximum.reduceat(block["novelty"], at).tolist(),
                np.minimum.reduceat(block["t"], at).tolist(), np.maximum.reduceat(block["t"], at).tolist()]

    def joined(self, outlines):
        return _thinned([np.concatenate([np.array(o[k], float) for o in outlines]) for k in range(4)], [np.maximum, np.maximum, np.minimum, np.maximum])

    def passes(self, outline, carry):
        if not 0.0 < self.threshold < 1.0:
            return False
        base, nov, lo, hi = (np.array(x, float) for x in outline)
        ages = [self.weights[3] * (np.minimum(t - carry["t"], 30.0) / 10.0) for t in (lo, hi)]
        z = base + np.maximum(*ages) + max(0.0, self.weights[4]) * np.maximum(0.0, nov - carry["v"])
        bar = np.log(self.threshold / (1.0 - self.threshold))
        return bool(np.all((hi - carry["t"] < self.min_gap_s) | (z < bar - 1e-9 * (1 + abs(bar)))))


@dataclass
class AdaptiveQuantile(Policy):
    """Threshold = rolling quantile of the stream's own novelty, current row included."""

    q: float
    window_s: float = 8.0
    min_gap_s: float = 0.3
    min_samples: int = 30
    min_novelty: float = 0.0
    kind = "adaptive_novelty"

    @property
    def point(self) -> float:
        return self.q

    def scan(self, block, carry):
        ok = self.allowed_after(block, carry)
        picks, t_last = _pick_with_gap(block["t"], ok, self.min_gap_s, carry.get("t"), True)
        picks = np.array(picks, dtype=np.int64)
        return picks, block["novelty"][picks], {"t": t_last, "h": self.history(block, carry)}

    def _with_history(self, block, carry):
        ht, hv = carry.get("h", [[], []])
        return np.concatenate([np.array(ht, float), block["t"]]), np.concatenate([np.array(hv, float), block["novelty"]]), len(ht)

    def allowed_after(self, block, carry) -> np.ndarray:
        t, v, skip = self._with_history(block, carry)
        thr = self._thresholds(t, v)[skip:]
        new = block["novelty"]
        return (new >= self.min_novelty) & (new >= thr)  # NaN threshold (too few samples) compares false

    def history(self, block, carry) -> list[list[float]]:
        """The rows a later row's window can still reach."""
        t, v, _ = self._with_history(block, carry)
        keep = t >= (t[-1] - self.window_s) if len(t) else slice(0)
        return [t[keep].tolist(), v[keep].tolist()]

    def _thresholds(self, t: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Quantile over [t - window, t] and up to the row itself, NaN below ``min_samples``."""
        lo = np.searchsorted(t, t - self.window_s, "left")
        return pd.Series(v).rolling(
            _Span(lo), min_periods=max(1, self.min_samples)
        ).quantile(self.q, interpolation="linear").to_numpy()


class _Span(pd.api.indexers.BaseIndexer):
    """Rolling window from a given first position to the row itself."""

    def __init__(self, lo: np.ndarray) -> None:
        super().__init__()
        self.lo = lo

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.lo.astype(np.int64), np.arange(1, num_values + 1, dtype=np.int64)


def _motion(value, **kw):
    return SignalThreshold("motion_threshold", "motion", value, **kw)


def _novelty(value, **kw):
    return SignalThreshold("embedding_novelty", "novelty", value, **kw)


def _learned(value, weights, bias, **kw):
    return Learned(list(weights), bias, threshold=value, **kw)


REGISTRY: dict[str, Any] = {
    "adaptive_novelty": AdaptiveQuantile,
    "fixed_interval": FixedInterval,
    "motion_threshold": _motion,
    "embedding_novelty": _novelty,
    "information_gain": InformationGain,
    "learned": _learned,
}


def make_policy(kind: str, value: float, **params: Any) -> Policy:
    if kind not in REGISTRY:
        raise ValueError(f"unknown policy {kind!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[kind](value, **params)


def register_policy(kind: str, factory) -> None:
    REGISTRY[kind] = factory


def policy_grid(kinds: list[str], points: dict[str, list[float]] | None = None, **params) -> list[Policy]:
    """Every kind at each of its operating points; ``params`` go to kinds that take a gap."""
    out = []
    for kind in kinds:
        for v in (points or OPERATING_POINTS)[kind]:
            extra = {} if kind == "fixed_interval" else params.get(kind, params.get("default", {}))
            out.append(make_policy(kind, v, **extra))
    return out


def linspace(lo: float, hi: float, n: int, digits: int) -> list[float]:
    return [round(float(x), digits) for x in np.linspace(lo, hi, n)]


# The cut-points of the dense curves.
def dense_grid(kind: str) -> list[float]:
    """Fine cut-points for locating optima."""
    if kind == "embedding_novelty":
        return linspace(0.005, 0.20, 40, 4) + linspace(0.21, 0.60, 20, 4)
    return linspace(0.0005, 0.05, 40, 5) + linspace(0.055, 0.20, 15, 5)


class Bank:
    """Many policies advanced together: one step per row over a vector with an entry per policy.

    A sweep has tens to hundreds of settings and often short streams, where scanning policy by policy
    spends its time on call overhead. A block with many more rows than policies is scanned policy by
    policy instead, each jumping from call to call. Kinds the bank does not know are always scanned.
    """

    #: Rows for each policy from which on a block is scanned policy by policy.
    LONG = 8

    def __init__(self, policies: list[Policy]) -> None:
        kinds = [type(p) for p in policies]
        self.policies = policies
        self.gap = [i for i, k in enumerate(kinds) if k in (FixedInterval, SignalThreshold, AdaptiveQuantile)]
        self.gain = [i for i, k in enumerate(kinds) if k is InformationGain]
        self.logit = [i for i, k in enumerate(kinds) if k is Learned]
        self.other = [i for i in range(len(policies)) if i not in {*self.gap, *self.gain, *self.logit}]

    def fire(self, block: dict[str, np.ndarray], carries: list[dict]) -> tuple[np.ndarray, list[dict]]:
        """(rows x policies) matrix of fired rows, and the carries after the block."""
        n, t, v = len(block["t"]), block["t"], block["novelty"]
        fired = np.zeros((n, len(self.policies)), bool)
        after = list(carries)
        for i in self.other:
            picks, _, after[i] = self.policies[i].scan(block, carries[i])
            fired[picks, i] = True
        for cols, step in ((self.gap, self._gap_step), (self.gain, self._gain_step), (self.logit, self._logit_step)):
            if not cols or n == 0:
                continue
            if n >= self.LONG * len(cols):
                for i in cols:
                    picks, _, carry = self.policies[i].scan(block, carries[i])
                    fired[picks, i] = True
                    after[i] = {**after[i], **carry}
                continue
            ps = [self.policies[i] for i in cols]
            last = np.array([carries[i].get("t", np.nan) if carries[i].get("t") is not None else np.nan for i in cols])
            held = np.array([carries[i].get("v", 0.0) for i in cols])
            rule = step(ps, block, [carries[i] for i in cols])
            out = np.zeros((n, len(cols)), bool)
            fresh = np.isnan(last)
            first = 0
            if fresh.any():  # a policy that never fired takes the first row it sees
                out[0] = fresh
                if not fresh.all():
                    out[0] |= ~fresh & rule(0, t[0] - last, held)
                first = 1
                last, held = np.where(out[0], t[0], last), np.where(out[0], v[0], held)
            for k in range(first, n):
                go = rule(k, t[k] - last, held)
                if go.any():
                    out[k] = go
                    last[go] = t[k]
                    held[go] = v[k]
            fired[:, cols] = out
            for j, i in enumerate(cols):
                after[i] = {**after[i], "t": float(last[j])}
                if cols is not self.gap:
                    after[i]["v"] = float(held[j])
        for i in self.gap:
            if isinstance(self.policies[i], AdaptiveQuantile) and n and n < self.LONG * len(self.gap):
                after[i]["h"] = self.policies[i].history(block, carries[i])
        return fired, after

    @staticmethod
    def _gap_step(ps, block, carries):
        ok = np.stack([p.allowed_after(block, c) if isinstance(p, AdaptiveQuantile) else p.allowed(block) for p, c in zip(ps, carries)], axis=1)
        gap = np.array([p.min_gap_s if isinstance(p, AdaptiveQuantile) else p.gap for p in ps])
        return lambda k, age, held: ok[k] & (age >= gap)

    @staticmethod
    def _gain_step(ps, block, carries):
        gap, thr, half = (np.array([getattr(p, a) for p in ps]) for a in ("min_gap_s", "threshold", "half_life_s"))
        v = block["novelty"]
        return lambda k, age, held: (age >= gap) & (
            np.maximum(0.0, v[k] - held) * (0.5 + 0.5 * (1.0 - np.power(0.5, age / half))) >= thr)

    @staticmethod
    def _logit_step(ps, block, carries):
        gap, thr = (np.array([getattr(p, a) for p in ps]) for a in ("min_gap_s", "threshold"))
        w = np.array([p.weights for p in ps]).T
        bias = np.array([p.bias for p in ps])
        v, c, m = block["novelty"], block["scene_change"], block["motion"]

        def rule(k, age, held):
            z = w[0] * v[k] + w[1] * c[k] + w[2] * m[k] + w[3] * (np.minimum(age, 30.0) / 10.0) + w[4] * np.maximum(0.0, v[k] - held) + bias
            return (age >= gap) & (1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))) >= thr)

        return rule


@dataclass
class Trigger(Kernel):
    """Runs a list of policies over a stream; emits one row per (policy, fired row)."""

    policies: list[Policy]
    extra: list[str] = field(default_factory=list)  # columns copied to the output
    extra_ddl: str = ""

    def __post_init__(self):
        self.columns = ["frame_idx", "t", *SIGNALS, *self.extra]
        self.schema = "policy string, point double, frame_idx long, t double, score double" + (
            ", " + self.extra_ddl if self.extra_ddl else ""
        )

    def start(self):
        return {"p": [{} for _ in self.policies]}

    def block(self, pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        out = {c: pdf[c].to_numpy(dtype=np.float64) for c in ("t", *SIGNALS)}
        out["frame_idx"] = pdf["frame_idx"].to_numpy(dtype=np.int64)
        return out

    def step(self, state, pdf):
        block = self.block(pdf)
        carries, frames = [], []
        for p, carry in zip(self.policies, state["p"]):
            picks, scores, carry = p.scan(block, carry)
            carries.append(carry)
            if len(picks):
                out = {
                    "policy": p.name, "point": float(p.point), "frame_idx": block["frame_idx"][picks],
                    "t": block["t"][picks], "score": scores,
                }
                for c in self.extra:
                    out[c] = pdf[c].to_numpy()[picks]
                frames.append(pd.DataFrame(out))
        return {"p": carries}, pd.concat(frames, ignore_index=True) if frames else None

    # A gap policy's chunk is a map "time of the last call before it" -> "time of the last call in
    # it". Only rows within one gap of the chunk start can be hit first, so the map is short. Other
    # policies keep an outline that tells whether any row of the chunk could fire after a given call.
    def probe(self, blocks):
        parts: list[list] = [[] for _ in self.policies]
        cold = self.start()
        for pdf in blocks:
            block = self.block(pdf)
            cold, _ = self.step(cold, pdf)
            for i, p in enumerate(self.policies):
                if p.gap_only:
                    ok = p.allowed(block)
                    parts[i].append((block["t"][ok], float(block["t"][0])))
                else:
                    parts[i].append(p.outline(block))
        maps = [_gap_map(p, x) if p.gap_only else None for p, x in zip(self.policies, parts)]
        outlines = [None if p.gap_only or None in x else p.joined(x) for p, x in zip(self.policies, parts)]
        return {"cold": cold["p"], "map": maps, "outline": outlines, "exit": self.chunk_entry(cold)}

    def through(self, probe, run, entry):
        out = [self._through_one(i, probe, run, entry["p"][i]) for i in range(len(self.policies))]
        return {"p": [x for x, _, _ in out]}, all(sure for _, sure, _ in out)

    def _through_one(self, i: int, probe, run, carry: dict) -> tuple[dict, bool, bool]:
        """Carry of a policy after the chunk, whether it is sure, and whether the policy surely did not call."""
        p = self.policies[i]
        if not carry:
            return probe["cold"][i], True, False
        if p.gap_only and carry.get("t") is not None:
            t = _through(probe["map"][i], carry["t"], p.gap)
            return {"t": carry["t"] if t is None else t}, True, t is None
        if run and run["entry"]["p"][i] == carry:
            return run["exit"]["p"][i], True, False
        if probe["outline"][i] is not None and p.passes(probe["outline"][i], carry):
            return carry, True, True
        return (run["exit"]["p"][i] if run else probe["cold"][i]), False, False


def _gap_map(p: Policy, parts: list) -> dict:
    t = np.concatenate([x for x, _ in parts]) if parts else np.array([])
    if not len(t):
        return {"t": [], "exit": []}
    start, gap = parts[0][1], p.gap
    n = len(t)
    if gap <= 0:
        return {"t": [float(t[0])], "exit": [float(t[-1])]}
    nxt = np.searchsorted(t, t + gap, "left")
    for i in np.flatnonzero(nxt > np.arange(n) + 1):  # align with the subtraction used row by row
        while nxt[i] - 1 > i and t[nxt[i] - 1] - t[i] >= gap:
            nxt[i] -= 1
    for i in np.flatnonzero(nxt < n):
        while nxt[i] < n and t[nxt[i]] - t[i] < gap:
            nxt[i] += 1
    nxt = np.maximum(nxt, np.arange(n) + 1)
    last = np.arange(n)
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            last[i] = last[nxt[i]]
    m = min(n, int(np.searchsorted(t, start + gap, "right")) + 1)
    return {"t": t[:m].tolist(), "exit": t[last[:m]].tolist()}


def _through(m: dict, t_last: float, gap: float) -> float | None:
    """Time of the last call of the chunk, None if it has none."""
    for t, out in zip(m["t"], m["exit"]):
        if t - t_last >= gap:
            return out
    return None


def _thinned(columns: list[np.ndarray], how: list) -> list[list[float]]:
    """At most OUTLINE points, each the bound (``how``: np.maximum or np.minimum) of neighbours."""
    n = len(columns[0])
    if n > OUTLINE:
        at = np.arange(0, n, -(-n // OUTLINE))
        columns = [f.reduceat(c, at) for f, c in zip(how, columns)]
    return [c.tolist() for c in columns]
