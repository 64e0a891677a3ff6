"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm.common import set_aside, text_bytes
from streamlens.llm.kernels import CACHES

#: A word is a run of a-z, 0-9 and bytes from 0x80 after lower-casing A-Z; everything else separates.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Bytes of item text in one automaton; a larger benchmark is scanned in blocks of items.
BLOCK_BYTES = 16 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def item_windows(items: list[tuple[str, bytes]], width: int) -> dict[bytes, tuple[int, list[int]]]:
    """Window text -> (its words, items that have it). An item shorter than ``width`` words is one window."""
    windows: dict[bytes, tuple[int, list[int]]] = {}
    for k, (_, text) in enumerate(items):
        words = words_of(text)
        if not words:
            continue
        w = min(width, len(words))
        for i in range(len(words) - w + 1):
            key = b" " + b" ".join(words[i : i + w]) + b" "
            size, owners = windows.setdefault(key, (w, []))
            if not owners or owners[-1] != k:
                owners.append(k)
    return windows


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[str, bytes], ...], width: int):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for key, (size, owners) in item_windows(list(items), width).items():
        automaton.add_word(key.decode("latin-1"), (size, owners))
    if len(automaton):
        automaton.make_automaton()
    return automaton


CACHES.append(_automaton.cache_clear)


def scan(text: bytes, automaton) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words, hit word ranges merged, items found) of one text."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), [], set()
    joined = b" " + b" ".join(words) + b" "
    ends, items = [], set()
    for end, (size, owners) in automaton.iter(joined.decode("latin-1")):
        ends.append((end, size))
        items.update(owners)
    if not ends:
        return len(words), [], items
    # the words before a blank are as many as the blanks before it
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    last = np.searchsorted(blanks, np.array([e for e, _ in ends]))
    spans: list[list[int]] = []
    for lo, hi in sorted((int(b) - size, int(b)) for b, (_, size) in zip(last, ends)):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    return len(words), [tuple(s) for s in spans], items


def original_offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of word ranges: normalising keeps byte positions."""
    word = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in spans]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[str, bytes]]]:
    """The items, ordered by id, in blocks whose texts have about ``block_bytes`` at most. Only one block is on the driver's
    way at a time and in an automaton at a time; null ids and texts have no words and are left out."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("i"), text_bytes().alias("t")).distinct()
    blocks, now, size = [], [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        if now and size + len(r.t) > block_bytes:
            blocks.append(now)
            now, size = [], 0
        now.append((r.i, bytes(r.t)))
        size += len(r.t)
    return blocks + [now] if now or not blocks else blocks


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """docs plus n_words, hits (array of start, end: character offsets in the original text of maximal hit runs), n_hit
    (hit words), items (ids found, sorted as strings). A text without words, or null, has none of them; an empty benchmark
    hits nothing; columns of docs with these names are replaced.

    A window is ``width`` consecutive words of an item, or the whole of a shorter item. All windows of all items form one
    automaton, built once per Python worker from the broadcast items; a text is scanned once, whole, without any shuffle.
    A benchmark over ``block_bytes`` is scanned in blocks one after the other, each adding its runs to what came before.
    """
    new = ("n_words", "hits", "n_hit", "items")
    docs = docs.drop(*new)
    names = docs.columns
    spark = docs.sparkSession
    out = docs.withColumns({"__words": F.lit(0).cast("long"), "__spans": F.array().cast("array<struct<a:int,b:int>>"), "__items": F.array().cast("array<string>")})
    for block in item_blocks(benchmark, block_bytes):
        out = _with_block(out, spark.sparkContext.broadcast(tuple(block)), width, text)
    offsets = F.pandas_udf(_offsets, "array<struct<start:int,end:int>>")
    where = out.withColumn("__found", offsets(F.struct(text_bytes(text).alias("t"), F.col("__spans").alias("s"))))
    runs = F.expr("aggregate(__spans, cast(0 as bigint), (n, s) -> n + s.b - s.a)")
    return where.select(
        *[F.col(f"`{c}`") for c in names], F.col("__words").alias("n_words"), F.col("__found").alias("hits"),
        runs.alias("n_hit"), F.array_sort(F.array_distinct("__items")).alias("items"))


_SCAN = "struct<n:bigint,spans:array<struct<a:int,b:int>>,items:array<string>>"


def _with_block(docs: DataFrame, block, width: int, text: str) -> DataFrame:
    @F.pandas_udf(_SCAN)
    def found(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        automaton, items = _automaton(block.value, width), block.value
        n, runs, names = [], [], []
        for t, old in zip(text, spans):
            k, s, i = scan(bytes(t) if t is not None else b"", automaton)
            n.append(k)
            runs.append([{"a": a, "b": b} for a, b in merge([(x["a"], x["b"]) for x in old] + s)] if len(old) else [{"a": a, "b": b} for a, b in s])
            names.append([items[j][0] for j in i])
        return pd.DataFrame({"n": n, "spans": runs, "items": names})

    step = docs.withColumn("__r", found(text_bytes(text), F.col("__spans")))
    return step.withColumns({"__words": F.col("__r.n"), "__spans": F.col("__r.spans"), "__items": F.concat("__items", "__r.items")}).drop("__r")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _offsets(rows: pd.DataFrame) -> pd.Series:
    return pd.Series([
        [{"start": a, "end": b} for a, b in original_offsets(bytes(t), [(x["a"], x["b"]) for x in s])] if t is not None and len(s) else []
        for t, s in zip(rows["t"], rows["s"])])


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Documents without a hit, with the columns of docs, whatever they are called. (Those with one carry test questions or
    answers and are left out of training.)"""
    plain, back = set_aside(docs)
    text = next(c for c, n in back.items() if n == "text")
    return contamination(plain, benchmark, width, text=text).where("n_hit = 0").select(*[F.col(c).alias(n) for c, n in back.items()])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
