"""Stateful streaming operators: the batch kernels, fed micro-batch by micro-batch."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from streamlens.operators.fold import Kernel, _join_up, _segments

SHARD = "_shard"
#: Groups of keys that share state. Each call of the state API waits for an answer of the JVM (tens of milliseconds), so calls
#: are made by the group and not by the key. More of them where there are more cores or less memory.
SHARDS = 128

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state API below needs this store; state then lives on disk, not on the heap. It is a setting of the session, so all
    streaming queries that start later use it; one that names another store is an error."""
    name = "spark.sql.streaming.stateStore.providerClass"
    now = spark.conf.get(name, "")
    if now and now != ROCKSDB and "HDFSBackedStateStoreProvider" not in now:
        raise ValueError(f"stateful operators need {ROCKSDB}; this session is set to {now}")
    spark.conf.set(name, ROCKSDB)


class Buckets:
    """What waits of one key, by stretches of ``width_ms`` of event time: a batch reads and writes the stretches it has rows of,
    however much the key holds besides.

    Every batch adds a piece of its own (a table as bytes) to a stretch, so nothing that is there already is written again. One
    small value lists the stretches that hold something, with their number of pieces.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, width_ms: int) -> None:
        self.width = width_ms
        self.pieces = handle.getMapState(name, "bucket long, piece int", "rows binary")
        self.index = handle.getValueState(f"{name}-index", "buckets array<long>, pieces array<int>")

    def held(self) -> dict[int, int]:
        """Stretches that hold rows, in order, and their pieces."""
        if not self.index.exists():
            return {}
        buckets, pieces = self.index.get()
        return {int(b): int(n) for b, n in zip(buckets, pieces)}

    def note(self, held: dict[int, int]) -> None:
        order = sorted(b for b, n in held.items() if n)
        if order:
            self.index.update((order, [held[b] for b in order]))
        elif self.index.exists():
            self.index.clear()

    def add(self, pdf: pd.DataFrame, ms: str) -> dict[int, int]:
        """Put rows where they belong by column ``ms``; (stretch, its earliest new ms) of those touched."""
        held, touched = self.held(), {}
        for bucket, part in pdf.groupby(pdf[ms] // self.width, sort=True):
            bucket = int(bucket)
            n = held.get(bucket, 0)
            self.pieces.updateValue((bucket, n), (_packed(part),))
            held[bucket] = n + 1
            touched[bucket] = int(part[ms].min())
        self.note(held)
        return touched

    def read(self, bucket: int, n: int) -> pd.DataFrame:
        return pd.concat([_unpacked(self.pieces.getValue((bucket, i))[0]) for i in range(n)], ignore_index=True)

    def drop(self, bucket: int, n: int) -> None:
        for i in range(n):
            self.pieces.removeKey((bucket, i))

    def take(self, upto_ms: int, ms: str) -> tuple[pd.DataFrame | None, int | None]:
        """All rows up to ``upto_ms``, taken out, and the earliest ms that is left in the stretch that holds ``upto_ms``."""
        held, out, low = self.held(), [], None
        for bucket in [b for b in held if b * self.width <= upto_ms]:
            rows = self.read(bucket, held[bucket])
            self.drop(bucket, held.pop(bucket))
            rest = rows[rows[ms] > upto_ms]
            if len(rest):
                self.pieces.updateValue((bucket, 0), (_packed(rest),))
                held[bucket] = 1
                low = int(rest[ms].min())
            out.append(rows[rows[ms] <= upto_ms])
        if out:
            self.note(held)
        return (pd.concat(out, ignore_index=True) if out else None), low


def next_timer(handle: StatefulProcessorHandle, waiting: Buckets, low: int | None) -> None:
    """After ``take``: one timer for what still waits, ``low`` or else the start of the first stretch, which lies behind."""
    first = next(iter(waiting.held()), None)
    if first is not None:
        handle.registerTimer(low if low is not None else first * waiting.width)


def in_shards(df: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """Number of the group that a row's key belongs to. Keys with NULLs have groups of their own, whose number tells which are
    NULL (``true_key``); in the columns a filler stands for them, since a NULL turns a column into floating point in pandas."""
    n, fill = F.lit(0), {}
    for i, k in enumerate(keys):
        kind = df.schema[k].dataType
        n = n + F.when(F.col(k).isNull(), F.lit(shards * 2**i)).otherwise(F.lit(0))
        filler = "1970-01-01" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "0"
        fill[k] = F.coalesce(F.col(k), F.lit(filler).cast(kind))
    return df.withColumn(SHARD, (F.pmod(F.xxhash64(*keys), F.lit(shards)) + n).cast("long")).withColumns(fill)


def true_key(key: tuple, shard: int, shards: int) -> tuple:
    return tuple(None if shard // shards >> i & 1 else k for i, k in enumerate(key))


def _packed(pdf: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_all().to_pandas()


class FoldProcessor(StatefulProcessor):
    """Runs a kernel for the keys of a shard. With ``hold`` rows wait until the watermark has passed them, so they are
    folded in event order whatever order they arrive in; without it each micro-batch is sorted."""

    def __init__(self, kernel: Kernel, keys: list[str], order: list[str], event_ms: str | None, in_schema: T.StructType,
                 bucket_ms: int = 60_000, shards: int = SHARDS) -> None:
        self.kernel, self.keys, self.order, self.event_ms, self.in_schema = kernel, keys, order, event_ms, in_schema
        self.bucket_ms, self.shards = bucket_ms, shards

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", "rows binary")
        if self.event_ms:
            self.waiting = Buckets(handle, "waiting", self.bucket_ms)

    def _states(self) -> dict[tuple, str]:
        """JSON states of the shard's keys."""
        now = self.states.get()
        return {} if now is None else {tuple(r[:-1]): r[-1] for r in _unpacked(now[0]).astype(object).itertuples(index=False, name=None)}

    def _keep(self, states: dict[tuple, str]) -> None:
        cols = [*self.keys, "_state"]
        pdf = pd.DataFrame({c: [k[i] for k in states] for i, c in enumerate(self.keys)} | {"_state": list(states.values())}, columns=cols)
        self.states.update((_packed(pdf),))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Start from the states that a batch fold of earlier rows ended in (``fold.end_states``)."""
        states = self._states()
        for k, part in _segments(initialState.reset_index(drop=True), self.keys):
            states[k] = str(part["_state"].iloc[-1])
        self._keep(states)

    def _step(self, shard: int, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(pdf):
            return
        pdf = pdf.sort_values([*self.keys, *self.order], ignore_index=True)
        states, parts = self._states(), []
        for key, block in _segments(pdf, self.keys):
            state = json.loads(states[key]) if key in states else self.kernel.start()
            state, out = self.kernel.step(state, block)
            states[key] = json.dumps(state)
            if out is not None and len(out):
                parts.append((true_key(key, shard, self.shards), out))
        self._keep(states)
        if parts:
            yield _join_up(parts, list(range(len(self.keys))), self.keys)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf.columns = self.in_schema.names  # computed columns reach the worker by position
        if not self.event_ms:
            yield from self._step(int(key[0]), pdf)
            return
        self.handle.registerTimer(min(self.waiting.add(pdf, self.event_ms).values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the first of several timers takes all that is due, in order; the others find nothing
        ready, low = self.waiting.take(timerValues.getCurrentWatermarkInMs(), self.event_ms)
        next_timer(self.handle, self.waiting, low)
        if ready is not None:
            yield from self._step(int(key[0]), ready)

    def close(self) -> None:
        pass


def stream_fold(df: DataFrame, kernel: Kernel, keys: list[str], order: list[str], hold: str | None = None,
                start: DataFrame | None = None, bucket_s: float = 60.0, shards: int = SHARDS) -> DataFrame:
    """``kernel`` over a stream. ``hold``: watermarked timestamp column to wait for, or None; what waits is kept in stretches of
    ``bucket_s`` seconds. ``start``: states to go on from (keys, ``_state``), as ``fold.end_states`` gives them for the rows
    before the stream; a key without one starts cold. The state is kept in ``shards`` groups of keys; a batch reads and writes
    the states of the groups it has rows of."""
    use_rocksdb(df.sparkSession)
    cols = list(dict.fromkeys([*keys, *order, *kernel.columns]))
    rows = df.select(*cols, *([hold] if hold else []))
    if hold:
        rows = rows.withColumn("_ms", F.unix_millis(F.col(hold)))
    rows = in_shards(rows, keys, shards)
    out = T.StructType([df.schema[k] for k in keys] + list(T._parse_datatype_string(kernel.schema).fields))
    # The timestamp only drives the watermark; what is buffered are the kernel's own columns.
    in_schema = T.StructType([f for f in rows.schema.fields])
    proc = FoldProcessor(kernel, keys, order, "_ms" if hold else None, in_schema, int(bucket_s * 1000), shards)
    return rows.groupBy(SHARD).transformWithStateInPandas(
        proc, outputStructType=out, outputMode="Append", timeMode="EventTime" if hold else "None",
        initialState=None if start is None else in_shards(start.select(*keys, "_state"), keys, shards).groupBy(SHARD))


class AsOfProcessor(StatefulProcessor):
    """Holds each question until the watermark passes it, then takes the last evidence not after it; of evidence of one time
    that with the largest frame_idx, as the batch join does.

    Questions and evidence lie in stretches of event time (``Buckets``). A batch touches the stretches of its own rows; a due
    question the stretch it is in and, if that has nothing before it, the last one before that holds evidence. Evidence is
    kept as far back as a question can still ask: from the last stretch before the watermark, or before the oldest waiting
    question, on - with questions or without. Older stretches go unread.
    """

    def __init__(self, keys: list[str], bucket_ms: int = 60_000) -> None:
        self.keys, self.bucket_ms = keys, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queries = Buckets(handle, "queries", self.bucket_ms)
        self.evidence = Buckets(handle, "evidence", self.bucket_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf.columns = [*self.keys, "ts", "t", "side", "query_id", "frame_idx", "answer", "ms"]
        q, e = pdf[pdf["side"] == 1], pdf[pdf["side"] == 0]
        if len(q):
            for low in self.queries.add(q[["query_id", "t", "ms"]], "ms").values():
                self.handle.registerTimer(low)
        if len(e):
            self.evidence.add(e[["t", "frame_idx", "answer", "ms"]].astype({"frame_idx": "int64"}), "ms")
            self._prune(timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = timerValues.getCurrentWatermarkInMs()
        ready, low = self.queries.take(at, "ms")
        if low is not None:
            self.handle.registerTimer(low)
        if ready is None or not len(ready):
            return
        held = self.evidence.held()
        order = sorted(held)
        read: dict[int, list] = {}

        def rows_of(bucket: int) -> list:
            if bucket not in read:
                e = self.evidence.read(bucket, held[bucket]).sort_values(["t", "frame_idx"])
                read[bucket] = list(zip(e["t"].tolist(), e["frame_idx"].tolist(), e["answer"].tolist()))
            return read[bucket]

        out = []
        for qid, t, ms in ready.sort_values("t")[["query_id", "t", "ms"]].itertuples(index=False, name=None):
            found, bucket = None, int(ms) // self.bucket_ms
            if bucket in held:
                rows = rows_of(bucket)
                i = bisect.bisect_right(rows, t, key=lambda e: e[0])
                found = rows[i - 1] if i else None
            if found is None:
                i = bisect.bisect_left(order, bucket)
                found = rows_of(order[i - 1])[-1] if i else (None, None, None)
            out.append((*key, qid, t, *found))
        self._prune(at)
        yield pd.DataFrame(out, columns=[*self.keys, "query_id", "t", "evidence_t", "frame_idx", "answer"])

    def _prune(self, watermark_ms: int) -> None:
        # all evidence up to the watermark is here; waiting questions are known by the stretch of the oldest
        oldest = next(iter(self.queries.held()), None)
        low = watermark_ms // self.bucket_ms if oldest is None else min(watermark_ms // self.bucket_ms, oldest)
        held = self.evidence.held()
        gone = [b for b in held if b < low][:-1]
        for b in gone:
            self.evidence.drop(b, held.pop(b))
        if gone:
            self.evidence.note(held)

    def close(self) -> None:
        pass


class AsOfShards(StatefulProcessor):
    """The same for the keys of a shard, many of which share a stretch.

    Evidence of the stretches that no question can ask about any more shrinks to the last row of each key (``latest``), so a due
    batch of questions reads that and the stretches since. Every stretch is read when its questions are due and dropped then.
    """

    def __init__(self, keys: list[str], bucket_ms: int, shards: int = SHARDS) -> None:
        self.keys, self.bucket_ms, self.shards = keys, bucket_ms, shards

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queries = Buckets(handle, "queries", self.bucket_ms)
        self.evidence = Buckets(handle, "evidence", self.bucket_ms)
        self.latest = handle.getValueState("latest", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf.columns = [*self.keys, "ts", "t", "side", "query_id", "frame_idx", "answer", "ms", SHARD]
        q, e = pdf[pdf["side"] == 1], pdf[pdf["side"] == 0]
        if len(e):
            self.evidence.add(e[[*self.keys, "t", "frame_idx", "answer", "ms"]], "ms")
        if len(q):
            self.handle.registerTimer(min(self.queries.add(q[[*self.keys, "query_id", "t", "ms"]], "ms").values()))
        else:
            self._shrink(timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = timerValues.getCurrentWatermarkInMs()
        ready, low = self.queries.take(at, "ms")
        next_timer(self.handle, self.queries, low)
        if ready is None or not len(ready):
            return
        last = int(ready["ms"].max()) // self.bucket_ms
        read = self._read([b for b in self.evidence.held() if b <= last])
        out = last_before(ready, self._known(read), self.keys)
        for k, x in zip(self.keys, true_key(tuple(self.keys), int(key[0]), self.shards)):
            if x is None:
                out[k] = None
        yield out
        self._shrink(at, read)

    def _read(self, buckets: list[int]) -> dict[int, pd.DataFrame]:
        held = self.evidence.held()
        return {b: self.evidence.read(b, held[b]) for b in buckets}

    def _known(self, read: dict[int, pd.DataFrame]) -> pd.DataFrame:
        now = self.latest.get()
        parts = ([] if now is None else [_unpacked(now[0])]) + list(read.values())
        cols = [*self.keys, "t", "frame_idx", "answer", "ms"]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=cols)

    def _shrink(self, watermark_ms: int, read: dict[int, pd.DataFrame] | None = None) -> None:
        # all evidence up to the watermark is here; waiting questions are known by the stretch of the oldest
        low = min([watermark_ms // self.bucket_ms, *self.queries.held()])
        held = self.evidence.held()
        gone = [b for b in held if b < low]
        if not gone:
            return
        read = read or {}
        old = self._known({b: read[b] for b in gone if b in read} | self._read([b for b in gone if b not in read]))
        rest = old.sort_values(["t", "frame_idx"]).groupby(self.keys, dropna=False, sort=False).tail(1)
        self.latest.update((_packed(rest),))
        for b in gone:
            self.evidence.drop(b, held.pop(b))
        self.evidence.note(held)

    def close(self) -> None:
        pass


def last_before(questions: pd.DataFrame, evidence: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Each question with its key's last evidence not after it; of evidence of one time that with the largest frame_idx."""
    n = len(evidence)
    code = pd.concat([evidence[keys], questions[keys]] if n else [questions[keys]], ignore_index=True).groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    t = np.concatenate([evidence["t"].to_numpy(float), questions["t"].to_numpy(float)])
    frame = np.concatenate([evidence["frame_idx"].to_numpy("int64"), np.zeros(len(questions), "int64")])
    asks = np.arange(len(t)) >= n
    order = np.lexsort((frame, asks, t, code))  # at one time evidence comes first
    first = np.ones(len(t), bool)
    first[1:] = code[order][1:] != code[order][:-1]
    place = np.arange(len(t))
    seen = np.maximum.accumulate(np.where(asks[order], -1, place))
    found = seen >= np.maximum.accumulate(np.where(first, place, 0))
    here = asks[order]
    q, hit, e = order[here] - n, found[here], order[seen[here]]
    out = questions.iloc[q][[*keys, "query_id", "t"]].reset_index(drop=True)
    e = e[hit]
    idx = np.zeros(len(q), "int64")
    idx[hit] = frame[e]
    times, answers = np.full(len(q), np.nan), np.full(len(q), None, object)
    times[hit], answers[hit] = t[e], evidence["answer"].to_numpy(object)[e]
    out["evidence_t"], out["frame_idx"], out["answer"] = pd.array(times, dtype="Float64"), pd.arrays.IntegerArray(idx, ~hit), answers
    return out


def stream_asof(queries: DataFrame, evidence: DataFrame, keys: list[str], event_time: str, delay: str, bucket_s: float = 60.0,
                shards: int = SHARDS) -> DataFrame:
    """Questions and evidence (same ``keys``, ``t``, timestamp ``event_time``, of one order) -> answered questions. State is kept in
    stretches of ``bucket_s`` seconds: a fair part of the delay where there are many keys of few rows. ``shards``: groups of keys
    that share state; 0 gives every key its own (few keys of very many rows), and ``bucket_s`` is then best about what a question
    is usually away from its evidence."""
    use_rocksdb(queries.sparkSession)
    q = queries.select(*keys, event_time, "t", F.lit(1).alias("side"), "query_id",
                       F.lit(None).cast("long").alias("frame_idx"), F.lit(None).cast("string").alias("answer"))
    e = evidence.select(*keys, event_time, "t", F.lit(0).alias("side"), F.lit(None).cast("string").alias("query_id"),
                        "frame_idx", "answer")
    both = q.unionByName(e).withColumn("ms", F.ceil(F.unix_micros(F.col(event_time)) / 1000.0).cast("long"))
    both = both.withWatermark(event_time, delay)
    out = T.StructType([queries.schema[k] for k in keys] + [
        T.StructField("query_id", T.StringType()), T.StructField("t", T.DoubleType()),
        T.StructField("evidence_t", T.DoubleType()), T.StructField("frame_idx", T.LongType()),
        T.StructField("answer", T.StringType())])
    if shards:
        groups, proc = in_shards(both, keys, shards).groupBy(SHARD), AsOfShards(keys, int(bucket_s * 1000), shards)
    else:
        groups, proc = both.groupBy(*keys), AsOfProcessor(keys, int(bucket_s * 1000))
    return groups.transformWithStateInPandas(proc, outputStructType=out, outputMode="Append", timeMode="EventTime")
