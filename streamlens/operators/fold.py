"""Ordered folds: a small per-row-block kernel run over every stream.

A kernel is ``step(state, block) -> (state, rows)``. The same kernel serves three callers:

* the Arrow batches of sorted partitions (many short streams or part of a long one, one batch in memory),
* the chunks of a stream too large for one task,
* the micro-batches of a streaming query (``streamlens.streaming``).

Chunks run in parallel. Each needs the state its predecessor ends in. ``probe`` runs every chunk once
without knowing its entry and keeps what tells how an entry passes through it; ``through`` leads a
state through a chunk from that and from the chunk's last run, and says whether the result is sure.
All chunks that are not sure are run at once from the best guess, until all are: each round makes at
least the first of them sure, and every later one whose guess was right or that needs no run. The
outcome is the sequential result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlens.operators.layout import CHUNK, Laid, join_on
from streamlens.session import cut_lineage

ENTRY = "_entry"


class Kernel:
    """Subclass with plain picklable attributes; states are JSON-able dicts."""

    columns: list[str] = []  # input columns used
    schema: str = ""  # DDL of the produced rows, without the key columns

    def start(self) -> dict[str, Any]:
        raise NotImplementedError

    def step(self, state: dict, block: pd.DataFrame) -> tuple[dict, pd.DataFrame | None]:
        raise NotImplementedError

    def finish(self, state: dict) -> pd.DataFrame | None:
        """Rows produced at the end of a stream or chunk."""
        return None

    def chunk_entry(self, state: dict) -> dict:
        """State a chunk starts from, given its predecessor's final state."""
        return state

    # -- parallel chunks -------------------------------------------------------------------
    def probe(self, blocks: Iterator[pd.DataFrame]) -> Any:
        """Summary of a chunk run without knowing its entry: by default the state a cold run ends in."""
        state = self.start()
        for block in blocks:
            state, _ = self.step(state, block)
        return self.chunk_entry(state)

    def through(self, probe: Any, run: dict | None, entry: dict) -> tuple[dict, bool]:
        """State after a chunk entered with ``entry``, and whether that is sure. ``run``: entry and exit of the chunk's last run."""
        if self.same(entry, self.start()):
            return probe, True  # the probe is that run
        return (run["exit"], self.same(run["entry"], entry)) if run else (probe, False)

    def same(self, a: dict, b: dict) -> bool:
        return a == b


def _key_fields(df: DataFrame, keys) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Whole groups per partition, each group's rows together and sorted.

    Input already laid out this way (by a window on the same keys) is not shuffled or sorted again.
    """
    sort = ["_first", *order] if ENTRY in df.columns else list(order)
    return df.repartition(*keys).sortWithinPartitions(*keys, *sort)


def _take_entry(pdf: pd.DataFrame) -> tuple[dict | None, pd.DataFrame]:
    """Split off the entry state that heads a chunk's rows, if this block holds it."""
    if ENTRY not in pdf.columns:
        return None, pdf
    mine = pdf[ENTRY].notna().to_numpy()
    if not mine.any():
        return None, pdf
    return json.loads(pdf.loc[mine, ENTRY].iloc[0]), pdf[~mine].reset_index(drop=True)


def _segments(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Stretches of equal key in a sorted block."""
    new = np.zeros(len(pdf), bool)
    cols = [pdf[k] for k in keys]
    for c in cols:
        v, gone = c.to_numpy(), c.isna().to_numpy()
        new[1:] |= (v[1:] != v[:-1]) & ~(gone[1:] & gone[:-1])
    edges = [0, *np.flatnonzero(new).tolist(), len(pdf)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi > lo:
            key = tuple(None if pd.isna(c.iloc[lo]) else c.iloc[lo] for c in cols)
            yield key, pdf.iloc[lo:hi].reset_index(drop=True)


def _join_up(parts: list[tuple[tuple, pd.DataFrame]], at: list[int], names: list[str]) -> pd.DataFrame:
    """One frame from the rows of several groups, with their keys in front."""
    out = pd.concat([p for _, p in parts], ignore_index=True)
    sizes = [len(p) for _, p in parts]
    for i, n in zip(at, names):
        values = [k[i] for k, _ in parts]
        plain = all(isinstance(x, (int, np.integer)) for x in values)
        out.insert(i, n, np.repeat(np.array(values, dtype=np.int64 if plain else object), sizes))
    return out


def _run_rows(df: DataFrame, keys: list[str], order: list[str], kernel: Kernel) -> DataFrame:
    """Produce the kernel's rows. Batches hold many short streams or a part of a long one."""
    names = [k for k in keys if k != CHUNK]
    at = [keys.index(n) for n in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            parts: list[tuple[tuple, pd.DataFrame]] = []

            def add(k, out, parts=parts):
                if out is not None and len(out):
                    parts.append((k, out))

            for k, block in _segments(pdf, keys):
                if state is None or k != key:
                    if state is not None:
                        add(key, kernel.finish(state))
                    key, state = k, kernel.start()
                entry, block = _take_entry(block)
                state = entry if entry is not None else state
                if len(block):
                    state, out = kernel.step(state, block)
                    add(k, out)
            if parts:
                yield _join_up(parts, at, names)
        if state is not None:
            out = kernel.finish(state)
            if out is not None and len(out):
                yield _join_up([(key, out)], at, names)

    schema = T.StructType(_key_fields(df, names) + list(T._parse_datatype_string(kernel.schema).fields))
    return _in_order(df, keys, order).mapInPandas(run, schema)


def _run_states(df: DataFrame, keys: list[str], order: list[str], kernel: Kernel, cold: bool, whole: bool = False) -> DataFrame:
    """One row per chunk: its probe (``cold``) or the state it ends in when begun from its entry, as the next chunk needs it or
    ``whole``."""
    schema = T.StructType([*_key_fields(df, keys), T.StructField("_state", T.StringType())])

    def probe(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        result = kernel.probe(b.reset_index(drop=True) for b in batches)
        yield pd.DataFrame([[*key, json.dumps(result)]], columns=[*keys, "_state"])

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches hold many short streams or a part of a long one."""
        key, state = None, None
        for pdf in batches:
            done = []
            for k, block in _segments(pdf, keys):
                if state is None or k != key:
                    if state is not None:
                        done.append((key, state))
                    key, state = k, kernel.start()
                entry, block = _take_entry(block)
                state = entry if entry is not None else state
                if len(block):
                    state, _ = kernel.step(state, block)
            if done:
                yield rows_of(done)
        if state is not None:
            yield rows_of([(key, state)])

    def rows_of(done: list[tuple[tuple, dict]]) -> pd.DataFrame:
        texts = [json.dumps(state if whole else kernel.chunk_entry(state)) for _, state in done]
        values = [[k[i] for k, _ in done] for i in range(len(keys))]
        return pd.DataFrame({**{n: pd.Series(v, dtype=object) for n, v in zip(keys, values)}, "_state": texts})

    laid = _in_order(df, keys, order)
    return laid.groupBy(*keys).applyInPandas(probe, schema) if cold else laid.mapInPandas(ends, schema)


def _with_entries(df: DataFrame, entries: DataFrame) -> DataFrame:
    """Put each chunk's entry state in front of its rows (one extra row per chunk)."""
    rows = df.withColumn("_first", F.lit(1)).withColumn(ENTRY, F.lit(None).cast("string"))
    heads = entries.withColumn("_first", F.lit(0)).withColumnRenamed("_state", ENTRY)
    return rows.unionByName(heads, allowMissingColumns=True)


def entry_states(rows: DataFrame, keys: list[str], order: list[str], kernel: Kernel) -> DataFrame:
    """State in which every chunk of the split streams starts: ``keys, _chunk, _state``."""
    parts = [*keys, CHUNK]
    probes = cut_lineage(_run_states(rows, parts, order, kernel, cold=True))
    schema = T.StructType([*probes.schema.fields, T.StructField("_need", T.BooleanType())])

    def resume(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK, ignore_index=True)
        entry, entries, need = kernel.start(), [], []
        for probe, run in zip(pdf["_state"], pdf["_run"]):
            entries.append(json.dumps(entry))
            entry, sure = kernel.through(json.loads(probe), None if run is None else json.loads(run), entry)
            need.append(not sure)
        need[-1] = False  # nothing follows
        pdf["_state"], pdf["_need"] = entries, need
        return pdf.drop(columns="_run")

    runs = None
    while True:
        known = probes.withColumn("_run", F.lit(None).cast("string")) if runs is None else join_on(probes, runs, parts, "left")
        # One row per chunk, so a group here has (rows of the stream / chunk size) rows.
        plan = cut_lineage((known.groupBy(*keys) if keys else known.groupBy()).applyInPandas(resume, schema))
        entries, todo = plan.drop("_need"), plan.filter("_need").drop("_need")
        if todo.isEmpty():
            return entries
        some = join_on(rows, todo.select(*parts), parts, "left_semi")
        exits = _run_states(_with_entries(some, todo), parts, order, kernel, cold=False).withColumnRenamed("_state", "_exit")
        both = F.concat(F.lit('{"entry":'), "_state", F.lit(',"exit":'), "_exit", F.lit("}"))
        fresh = join_on(exits, todo, parts).select(*parts, both.alias("_run"))
        runs = cut_lineage(fresh if runs is None else fresh.unionByName(join_on(runs, todo.select(*parts), parts, "left_anti")))


def fold(laid: Laid, kernel: Kernel) -> DataFrame:
    """Run ``kernel`` over every stream of ``laid``; rows come out with the key columns in front."""
    keys, order = list(laid.keys), list(laid.order)
    wanted = list(dict.fromkeys([*laid.parts, *order, *kernel.columns]))
    rows = laid.df.select(*wanted)
    if not laid.split:
        return _run_rows(rows, keys, order, kernel)
    large = rows.filter(F.col(CHUNK) >= 0)
    large = large.persist(StorageLevel.DISK_ONLY)  # read once per round; rebuilt if an executor goes
    try:
        entries = entry_states(large, keys, order, kernel)
    finally:
        large.unpersist()
    return _run_rows(_with_entries(rows, entries), [*keys, CHUNK], order, kernel)


def end_states(laid: Laid, kernel: Kernel) -> DataFrame:
    """The state in which ``kernel`` leaves every stream, ``keys, _state``: what a stream over the rows that follow starts from
    (``streaming.state.stream_fold``)."""
    keys, order = list(laid.keys), list(laid.order)
    rows = laid.df.select(*dict.fromkeys([*laid.parts, *order, *kernel.columns]))
    if not laid.split:
        return _run_states(rows, keys, order, kernel, cold=False, whole=True)
    large = rows.filter(F.col(CHUNK) >= 0).persist(StorageLevel.DISK_ONLY)
    try:
        entries = entry_states(large, keys, order, kernel)
    finally:
        large.unpersist()
    ends = _run_states(_with_entries(rows, entries), [*keys, CHUNK], order, kernel, cold=False, whole=True)
    return ends.groupBy(*keys).agg(F.max_by("_state", CHUNK).alias("_state"))
