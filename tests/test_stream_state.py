"""State in stretches of event time, and streams that go on from the states of a batch."""

import numpy as np
import pandas as pd
import pytest
from helpers import TRACE, random_rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlens.operators.cache import CacheRun
from streamlens.operators.fold import end_states, fold
from streamlens.operators.layout import lay_out
from streamlens.operators.policies import AdaptiveQuantile, FixedInterval, InformationGain, Trigger, make_policy
from streamlens.operators.signals import Reference
from streamlens.streaming import state, windows


class FakeValue:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class FakeMap:
    """A map state that notes what is read and written."""

    def __init__(self):
        self.d, self.touched = {}, set()

    def getValue(self, k):
        self.touched.add(k[0])
        return self.d[k]

    def updateValue(self, k, v):
        self.touched.add(k[0])
        self.d[k] = v

    def removeKey(self, k):
        del self.d[k]


class FakeHandle:
    def __init__(self):
        self.maps, self.timers = {}, []

    def getValueState(self, name, schema):
        return FakeValue()

    def getMapState(self, name, k, v):
        self.maps[name] = FakeMap()
        return self.maps[name]

    def registerTimer(self, ms):
        self.timers.append(ms)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def rows(evidence, questions):
    cols = ["k", "ts", "t", "side", "query_id", "frame_idx", "answer", "ms"]
    e = [("a", None, t, 0, None, f, "x", int(np.ceil(t * 1000))) for t, f in evidence]
    q = [("a", None, t, 1, i, None, None, int(np.ceil(t * 1000))) for t, i in questions]
    return pd.DataFrame(e + q, columns=cols)


def test_a_batch_touches_its_own_stretches_only():
    p, h = state.AsOfProcessor(["k"], 10_000), FakeHandle()
    p.init(h)
    many = [(float(t), t) for t in range(5000)]
    list(p.handleInputRows(("a",), iter([rows(many, [])]), At(0)))
    ev, qs = h.maps["evidence"], h.maps["queries"]
    assert len({b for b, _ in ev.d}) == 500
    ev.touched.clear()
    list(p.handleInputRows(("a",), iter([rows([(4321.5, 9), (4999.2, 7)], [(4330.0, "q"), (6000.0, "far")])]), At(0)))
    assert ev.touched == {432, 499} and qs.touched == {433, 600}
    ev.touched.clear(), qs.touched.clear()
    (got,) = p.handleExpiredTimer(("a",), At(4_400_000), None)
    assert got.values.tolist() == [["a", "q", 4330.0, 4330.0, 4330, "x"]]
    assert ev.touched == {433} and qs.touched == {433}  # nothing else was read, and what is behind is gone
    assert min(b for b, _ in ev.d) == 439 and {b for b, _ in qs.d} == {600}
    ev.touched.clear()
    (got,) = p.handleExpiredTimer(("a",), At(6_100_000), None)
    assert got["evidence_t"].tolist() == [4999.2] and ev.touched == {499}  # the last stretch before that holds evidence
    assert {b for b, _ in ev.d} == {499}


def test_waiting_rows_are_not_written_again():
    w = state.Buckets(h := FakeHandle(), "w", 1000)
    for k in range(10):
        w.add(pd.DataFrame({"ms": [500, 1500 + k], "v": [k, k]}), "ms")
    m = h.maps["w"]
    assert len(m.d) == 20
    m.touched.clear()
    ready, low = w.take(1504, "ms")
    assert sorted(ready["ms"]) == [500] * 10 + list(range(1500, 1505)) and low == 1505 and len(m.d) == 1
    assert w.held() == {1: 1}
    ready, low = w.take(5000, "ms")
    assert len(ready) == 5 and low is None and not m.d and w.held() == {}


@pytest.mark.parametrize("width", [0.5, 5.0, 1000.0])
def test_streaming_asof_equals_the_join_on_shuffled_rows(spark, tmp_path, width):
    rng = np.random.default_rng(int(width))
    e = [(k, float(t), i, f"a{i}") for k in ("a", "b") for i, t in enumerate(rng.choice(np.arange(0, 60, 0.25), 80))]
    q = [(k, float(t), f"{k}{i}") for k in ("a", "b") for i, t in enumerate(rng.choice(np.arange(0, 70, 0.25), 60))] + [("c", 5.0, "none")]
    ev = spark.createDataFrame(e, "stream_id string, t double, frame_idx long, answer string")
    qs = spark.createDataFrame(q, "stream_id string, t double, query_id string")
    best = {}
    for k, t, i in q:
        best[i] = max(((x[1], x[2]) for x in e if x[0] == k and x[1] <= t), default=(None, None))
    both = [(k, t, 0, None, f, a) for k, t, f, a in e] + [(k, t, 1, i, None, None) for k, t, i in q]
    both = [both[i] for i in rng.permutation(len(both))] + [("end", 5000.0, 0, None, 0, "x")]
    ddl = "stream_id string, t double, side int, query_id string, frame_idx long, answer string"
    for lo in range(0, len(both), 80):
        d = spark.createDataFrame(both[lo : lo + 80], ddl).withColumn("ts", F.timestamp_micros(((F.col("t") + 1e6) * 1e6).cast("long")))
        d.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = windows.replay_source(spark, str(tmp_path / "in"), T._parse_datatype_string(ddl + ", ts timestamp"))
    out = state.stream_asof(s.where("side = 1"), s.where("side = 0"), ["stream_id"], "ts", "100 seconds", width)
    got = windows.run_to_parquet(out, str(tmp_path / "out"), str(tmp_path / "ck")).collect()
    assert {r.query_id: (r.evidence_t, r.frame_idx) for r in got} == best and len(got) == len(q)


KERNELS = [
    Trigger([FixedInterval(0.5), make_policy("embedding_novelty", 0.9), InformationGain(0.3), AdaptiveQuantile(0.9, 2.0, 0.3, 10)]),
    Reference(2.0),
    CacheRun(FixedInterval(0.1), [0.1, 0.2], 8, 1.0),
]


@pytest.mark.parametrize("kernel", KERNELS, ids=["triggers", "signals", "cache"])
@pytest.mark.parametrize("size", [None, 30])
def test_a_stream_goes_on_where_the_batch_ended(spark, tmp_path, chunks, kernel, size):
    """Rows before the cut in batch, those after it as a stream: together the rows of one batch over all."""
    rng = np.random.default_rng(1)
    ddl = TRACE + ", embedding array<double>"
    data = [(*r, rng.normal(size=3).round(3).tolist()) for k in ("a", "b") for r in random_rows(k, 100, 3)]
    late = [r for r in data if r[1] >= 60] + [("new", *r[1:]) for r in data[:20]]
    lay = lambda x: lay_out(spark.createDataFrame(x, ddl), ["stream_id"], ["frame_idx"])
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    want = [r for r in fold(lay([r for r in data if r[1] < 60] + late), kernel).collect() if r.stream_id == "new" or r.frame_idx >= 60]
    if size:
        chunks(size)
    start = end_states(lay([r for r in data if r[1] < 60]), kernel)
    assert start.count() == 2
    for lo in (60, 80):
        spark.createDataFrame([r for r in late if lo <= r[1] < lo + 20 or r[0] == "new" and lo == 60], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = windows.replay_source(spark, str(tmp_path / "in"), T._parse_datatype_string(ddl))
    out = state.stream_fold(s, kernel, ["stream_id"], ["frame_idx"], start=start)
    got = windows.run_to_parquet(out, str(tmp_path / "out"), str(tmp_path / "ck")).collect()
    assert want and key(got) == key(want)


class Counting(FakeHandle):
    """Counts the calls of the state API."""

    def __init__(self):
        super().__init__()
        self.calls, self.values = 0, {}

    def counted(self, what):
        for name in ("get", "exists", "update", "clear", "getValue", "updateValue", "removeKey"):
            if hasattr(what, name):
                def call(*args, _fn=getattr(what, name)):
                    self.calls += 1
                    return _fn(*args)

                setattr(what, name, call)
        return what

    def getValueState(self, name, schema):
        return self.counted(super().getValueState(name, schema))

    def getMapState(self, name, k, v):
        return self.counted(super().getMapState(name, k, v))

    def registerTimer(self, ms):
        self.calls += 1
        super().registerTimer(ms)


@pytest.mark.parametrize("hold", [None, "ms"])
def test_state_is_called_by_the_shard_and_not_by_the_key(spark, hold):
    """Every call waits for the JVM: 10 times the keys of a shard make no more of them, and the rows stay those of each key."""
    kernel = Trigger([make_policy("embedding_novelty", 0.5)])
    schema = T._parse_datatype_string("k long, frame_idx long, t double, motion double, novelty double, scene_change double, ms long, _shard long")
    calls, out = {}, {}
    for n in (5, 50):
        p, h = state.FoldProcessor(kernel, ["k"], ["frame_idx"], hold, schema, 10_000), Counting()
        p.init(h)
        got = []
        for lo in (0, 3):
            pdf = pd.DataFrame([(k, f, float(f), 0.0, (k * 7 + f * 3) % 10 / 10, 0.0, f * 1000, 0) for f in range(lo, lo + 3) for k in range(n)], columns=schema.names)
            got += list(p.handleInputRows((0,), iter([pdf]), At(0)))
        if hold:
            got += list(p.handleExpiredTimer((0,), At(60_000), None))
        calls[n], out[n] = h.calls, pd.concat(got)
    assert calls[5] == calls[50]
    small = out[50][out[50]["k"] < 5].sort_values(["k", "frame_idx"]).values.tolist()
    assert small == out[5].sort_values(["k", "frame_idx"]).values.tolist() and len(small)


def test_asof_shards_keep_the_last_evidence_of_every_key():
    """Stretches behind the watermark go; what a rarely seen key was told long before them stays."""
    keys = ["k"]
    p, h = state.AsOfShards(keys, 1000), Counting()
    p.init(h)

    def batch(e, q):
        cols = ["k", "ts", "t", "side", "query_id", "frame_idx", "answer", "ms", "_shard"]
        rows = [(k, None, t, 0, None, f, f"x{f}", int(t * 1000), 0) for k, t, f in e] + [(k, None, t, 1, i, None, None, int(t * 1000), 0) for k, t, i in q]
        return pd.DataFrame(rows, columns=cols)

    big = 2**53 + 1  # not a whole number of floating point
    list(p.handleInputRows((0,), iter([batch([("a", 1.0, big), ("b", 1.0, 3), ("b", 1.0, 4), ("b", 30.0, 5)], [])]), At(0)))
    list(p.handleInputRows((0,), iter([batch([("b", 31.0, 6)], [])]), At(20_000)))
    assert {b for b, _ in h.maps["evidence"].d} == {30, 31}
    list(p.handleInputRows((0,), iter([batch([], [("a", 40.0, "q1"), ("b", 29.5, "q2"), ("b", 31.0, "q3"), ("c", 35.0, "q4")])]), At(20_000)))
    (got,) = p.handleExpiredTimer((0,), At(50_000), None)
    assert {r.query_id: None if pd.isna(r.frame_idx) else int(r.frame_idx) for r in got.itertuples()} == {"q1": big, "q2": 4, "q3": 6, "q4": None}
    assert not h.maps["evidence"].d and not h.maps["queries"].d
    list(p.handleInputRows((0,), iter([batch([], [("b", 60.0, "q5")])]), At(50_000)))
    (got,) = p.handleExpiredTimer((0,), At(70_000), None)
    assert got["frame_idx"].tolist() == [6]


def test_null_keys_do_not_blur_the_other_keys_of_a_stream(spark, tmp_path):
    big = 2**53 + 1
    ddl = TRACE.replace("stream_id string", "stream_id long")
    data = [(k, *r[1:]) for k in (None, big, big - 1) for r in random_rows("a", 30, 4)]
    spark.createDataFrame(data, ddl).coalesce(1).write.parquet(str(tmp_path / "in"))
    kernel = KERNELS[0]
    s = windows.replay_source(spark, str(tmp_path / "in"), T._parse_datatype_string(ddl))
    got = windows.run_to_parquet(state.stream_fold(s, kernel, ["stream_id"], ["frame_idx"], shards=1), str(tmp_path / "out"), str(tmp_path / "ck")).collect()
    one = fold(lay_out(spark.createDataFrame(random_rows("a", 30, 4), TRACE), ["stream_id"], ["frame_idx"]), kernel).collect()
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert one and key(got) == key((k, *r[1:]) for k in (None, big, big - 1) for r in one)


def test_larger_tables_replay_in_as_many_batches(spark, tmp_path):
    """The stretches of a replay are its batches, however many files each of them has."""
    import glob

    from streamlens.plans.stream_queries import replayed

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions stay files of their own, as large ones do
    try:
        df = spark.range(600).select(F.col("id").alias("t_us"), (F.col("id") % 50).alias("stream_id"))
        stream = replayed(spark, df, "batches", "t_us")
        got = windows.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
        assert got.count() == 600 and len(glob.glob(str(tmp_path / "ck/commits/[0-9]*"))) <= 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
