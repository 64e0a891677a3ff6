"""Phrase collocations: counts of all frequent phrases by vertically partitioned, depth-truncated suffix subtrees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamlens.llm import kernels as K
from streamlens.llm.common import set_aside, stored, text_bytes

#: Words of the longest phrase, and occurrences a candidate needs.
DEPTH, LEAST = 5, 100
#: A phrase goes if a longer candidate around it has this percentage of its occurrences.
COVERED = 100
#: Leaves of a group of prefixes, the memory budget of one subtree build.
BUDGET = 250_000
#: Different keys a task counts before it hands them on.
HELD = 1_000_000
#: Bits of a filter for each key in it, and the most a filter may have (8 MB); a full filter lets more through, and drops nothing.
FILTER_BITS, FILTER_MOST = 64, 1 << 26
#: Salted parts of a language whose first rows are found before the languages' own.
SALTS = 64

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[[9, 32]] = True
_WORDS = [f"w{i}" for i in range(1, DEPTH + 1)]


# -- reading words -------------------------------------------------------------------------------------------------
def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _read(batch: pa.RecordBatch):
    """(keys of words, whether the next word follows in the same piece, row of each word, Words) for a slice at a time; the
    columns are lang and text. The key of a word stands for it and its language."""
    langs = batch.column(0).to_pylist()
    salt = {x: _salt(x) for x in set(langs)}
    of_row = np.array([salt[x] for x in langs], np.uint64)
    for w in K.batch_words(batch.column(1), lower=True, separator=_SEPARATOR):
        if len(w.hashes):
            row = np.repeat(np.arange(w.first, w.last), np.diff(w.at))
            piece = np.cumsum(_BREAK[w.data])[w.starts]
            follows = np.zeros(len(row), bool)
            follows[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
            yield K.mix(w.hashes ^ of_row[row]), follows, row, w


class _Tally:
    """Counts of keys with what comes along with the first of each, combined before anything is shuffled."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, keys: np.ndarray, *along: np.ndarray) -> None:
        if not len(keys):
            return
        u, first, n = np.unique(keys, return_index=True, return_counts=True)
        self.held.append((u, n, *(a[first] for a in along)))
        self.size += len(u)

    def combine(self) -> None:
        cols = [np.concatenate(c) for c in zip(*self.held)]
        order = np.argsort(cols[0], kind="stable")
        keys = cols[0][order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.held = [(keys[new], np.add.reduceat(cols[1][order], new), *(c[order][new] for c in cols[2:]))]
        self.size = len(new)

    def full(self) -> bool:
        if self.size > 2 * HELD:
            self.combine()
        return self.size > HELD

    def take(self) -> tuple[np.ndarray, ...] | None:
        if not self.held:
            return None
        self.combine()
        out, self.held, self.size = self.held[0], [], 0
        return out


def _count(rows: DataFrame, emit, batch_of, schema: str) -> DataFrame:
    """Counts within tasks: ``emit(batch)`` gives (keys, along...) and ``batch_of`` makes rows of what was counted."""
    def run(batches):
        K.release(caches=True)
        tally = _Tally()
        for batch in batches:
            for keys, *along in emit(batch):
                tally.add(keys, *along)
                if tally.full():
                    yield batch_of(*tally.take())
        out = tally.take()
        if out is not None:
            yield batch_of(*out)
        del tally
        K.release()

    return rows.mapInArrow(run, schema)


# -- filters -------------------------------------------------------------------------------------------------------
class Filter:
    """A bitmap that holds all its keys, and a few others: what it turns away is surely not in the set."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.mask = np.uint64(bits - 1)
        self.map = np.zeros(bits // 8, np.uint8)
        for k, b in blocks.items():
            self.map[k * 4096 : (k + 1) * 4096] = np.frombuffer(b, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.map[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def make_filter(keys: DataFrame, key: str) -> Filter:
    """Of the keys in a stored table. Its size is that of a bitmap of at most FILTER_MOST bits, whatever the table holds."""
    n = keys.count()
    bits = min(FILTER_MOST, max(1 << 18, 1 << (FILTER_BITS * max(n, 1) - 1).bit_length()))
    at = F.col(key).bitwiseAND(F.lit(bits - 1))
    blocks = keys.select(F.shiftright(at, 15).alias("block"), at.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return Filter(bits, {r["block"]: bytes(r["bits"]) for r in blocks.collect()})


# -- counting ------------------------------------------------------------------------------------------------------
def word_counts(rows: DataFrame) -> DataFrame:
    """(key, lang, word, n) of all words of rows (lang, text as bytes). Raises where two words have one key (64 bits)."""
    def emit(batch):
        langs = np.array(batch.column(0).to_pylist(), object)
        for keys, _, row, w in _read(batch):
            yield keys, _Slices(w), langs[row]

    class _Slices:
        def __init__(self, w):
            self.w = w

        def __getitem__(self, at):
            data = self.w.data.tobytes()
            return np.array([data[s:e].lower() for s, e in zip(self.w.starts[at].tolist(), self.w.ends[at].tolist())] + [None], object)[:-1]

    def batch_of(keys, n, words, langs):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(n)], ["key", "lang", "word", "n"])

    part = _count(rows, emit, batch_of, "key long, lang string, word binary, n long")
    both = part.groupBy("key").agg(F.min("lang").alias("lang"), F.max("lang").alias("_lang"), F.min("word").alias("word"), F.max("word").alias("_word"), F.sum("n").alias("n"))
    clash = F.raise_error(F.lit("two words have one 64-bit key"))
    return both.select("key", "lang", F.when((F.col("word") == F.col("_word")) & (F.col("lang") == F.col("_lang")), F.col("word")).otherwise(clash).alias("word"), "n")


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return K.mix(first * np.uint64(0x9E3779B97F4A7C15) + K.mix(second))


def _pair_keys(keys: np.ndarray) -> np.ndarray:
    return _pair_key(keys[:-1], keys[1:])


def pair_counts(rows: DataFrame, words: Filter) -> DataFrame:
    """(w1, w2, n) of the pairs of words next to each other that are both in the filter."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def emit(batch):
        for keys, follows, _, _ in _read(batch):
            known = shared.value.has(keys)
            at = np.flatnonzero(known[:-1] & known[1:] & follows[:-1])
            yield _pair_keys(keys)[at], keys[at], keys[at + 1]

    def batch_of(_, n, first, second):
        return pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(n)], ["w1", "w2", "n"])

    return _count(rows, emit, batch_of, "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("n"))


def _with_pair_key(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            first, second = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_pair_key(first, second).view(np.int64))], ["pair"])

    return pairs.select("w1", "w2").mapInArrow(run, "pair long")


def leaves(rows: DataFrame, words: Filter, pairs: Filter) -> DataFrame:
    """(w1 .. w5, n): different suffixes, cut after DEPTH words, at the end of their piece and before a pair that is not in the
    filter; those of one and two words are left out, as words and pairs are counted already. 0 stands for no word."""
    shared = rows.sparkSession.sparkContext.broadcast((words, pairs))

    def emit(batch):
        words, pairs = shared.value
        for keys, follows, _, _ in _read(batch):
            known = words.has(keys)
            n = len(keys)
            go = np.zeros(n + DEPTH, bool)
            at = np.flatnonzero(known[:-1] & known[1:] & follows[:-1])
            go[at] = pairs.has(_pair_keys(keys)[at])
            start = np.flatnonzero(go[:-1] & go[1:])
            out = np.zeros((len(start), DEPTH), np.uint64)
            out[:, 0] = keys[start]
            alive = np.ones(len(start), bool)
            for d in range(1, DEPTH):
                alive = alive & go[start + d - 1]
                out[alive, d] = keys[start[alive] + d]
            name = np.zeros(len(start), np.uint64)
            for d in range(DEPTH):
                name = K.mix(name + out[:, d] * np.uint64(2 * d + 3))
            yield name, out

    def batch_of(keys, n, suffix):
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(suffix[:, d]).view(np.int64)) for d in range(DEPTH)), pa.array(n)], [*_WORDS, "n"])

    part = _count(rows, emit, batch_of, ", ".join(f"{w} long" for w in _WORDS) + ", n long")
    return part.groupBy(*_WORDS).agg(F.sum("n").alias("n"))


# -- vertical partitioning -----------------------------------------------------------------------------------------
def grouped(found: DataFrame, budget: int) -> DataFrame:
    """Leaves with ``depth``, the words of the prefix they go by, and ``part``, the group of that prefix.

    A prefix with more leaves than the budget is lengthened by a word, as often as needed; the others are laid together, in
    the order of their hash, until a group is full. Only prefixes over the budget are ever joined back to the leaves as such,
    and there are at most (leaves / budget) of those a length.
    """
    depth = F.lit(1)
    for d in range(1, DEPTH - 1):
        heavy = stored(found.where(F.col(f"w{d}") != 0).groupBy(*_WORDS[:d]).count().where(F.col("count") > budget).drop("count").withColumn("_heavy", F.lit(1)), f"heavy-{d}")
        if heavy.isEmpty():
            break
        found = found.join(heavy, _WORDS[:d], "left").withColumn("_d", F.coalesce(F.col("_d") if "_d" in found.columns else F.lit(1), F.lit(1)) + F.coalesce("_heavy", F.lit(0))).drop("_heavy")
        depth = F.col("_d")
    # a shorter suffix than its prefix ends there: its zeros are words of the prefix
    prefix = [F.when(depth > i, F.col(w)).otherwise(F.lit(0)).alias(f"p{i + 1}") for i, w in enumerate(_WORDS)]
    rows = found.select(*_WORDS, "n", depth.alias("depth"), *prefix).drop("_d")
    names = [f"p{i}" for i in range(1, DEPTH + 1)]
    weights = stored(rows.groupBy(*names).agg(F.count("*").alias("leaves")), "prefixes")
    total = weights.agg(F.sum("leaves")).first()[0] or 0
    bins = max(1, -(-total // (64 * budget)))
    running = Window.partitionBy("bin").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    groups = weights.withColumn("bin", F.pmod(F.xxhash64(*names), F.lit(bins))).select(
        *names, F.struct("bin", F.floor((F.sum("leaves").over(running) - 1) / F.lit(budget)).alias("k")).alias("part"))
    return rows.join(groups, names).drop(*names)


def subtree(suffix: np.ndarray, n: np.ndarray, depth: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of the tree of sorted suffixes, level by level: (length, words, totals of the leaves below, whether the prefix that
    the group was cut by is longer than the node)."""
    order = np.lexsort(tuple(suffix[:, d] for d in range(DEPTH - 1, -1, -1)))
    suffix, n, depth = suffix[order], n[order], depth[order]
    new = np.zeros(len(n), bool)
    new[:1] = True
    for d in range(DEPTH):
        new[1:] |= suffix[1:, d] != suffix[:-1, d]
        at = np.flatnonzero(new)
        whole = suffix[at, d] != 0
        if d > 1 and whole.any():
            sums = np.add.reduceat(n, at)[whole]
            words = suffix[at[whole]].copy()
            words[:, d + 1 :] = 0
            yield d + 1, words, sums, depth[at[whole]] > d + 1


def phrase_counts(found: DataFrame, least: int, budget: int = BUDGET) -> DataFrame:
    """(words, f): phrases of 3 to DEPTH words that occur ``least`` times, and their occurrences."""
    groups = grouped(found, budget)

    def build(table: pa.Table) -> pa.Table:
        suffix = np.column_stack([table.column(w).to_numpy() for w in _WORDS])
        parts = list(subtree(suffix, table.column("n").to_numpy(), table.column("depth").to_numpy()))
        if not parts:
            return pa.table({"words": pa.array([], pa.list_(pa.int64())), "f": pa.array([], pa.int64()), "part": pa.array([], pa.bool_())})
        rows, sums, partial = [], [], []
        for m, words, f, part in parts:
            keep = (f >= least) | part
            if keep.any():
                rows += list(words[keep][:, :m])
                sums.append(f[keep])
                partial.append(part[keep])
        return pa.table({
            "words": pa.array(rows, pa.list_(pa.int64())), "f": pa.array(np.concatenate(sums) if sums else np.zeros(0, np.int64)),
            "part": pa.array(np.concatenate(partial) if partial else np.zeros(0, bool))})

    nodes = groups.groupBy("part").applyInArrow(build, "words array<long>, f long, part boolean")
    # a node above the cut is in several groups; all others are in one
    nodes = stored(nodes, "nodes")
    above = nodes.where("part").groupBy("words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return nodes.where("not part").select("words", "f").unionByName(above)


# -- scores --------------------------------------------------------------------------------------------------------
def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame, covered: int) -> DataFrame:
    """Candidates that no longer one covers, with the cut of least score: words, lang, a, l, r, n, score."""
    known = phrases.unionByName(words.select(F.array("key").alias("words"), F.col("n").alias("f")))
    # a longer candidate around a phrase holds one that is longer by a word, at least as often
    wider = phrases.where(F.size("words") > 2)
    ends = wider.select(F.expr("slice(words, 1, size(words) - 1)").alias("words"), "f").union(wider.select(F.expr("slice(words, 2, size(words) - 1)").alias("words"), "f"))
    around = ends.groupBy("words").agg(F.max("f").alias("around"))
    left = phrases.join(around, "words", "left").where(F.col("around").isNull() | (F.lit(100) * F.col("around") < F.lit(covered) * F.col("f"))).drop("around")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1))).select(
        "words", "f", "k", F.expr("slice(words, 1, k)").alias("first"), F.expr("slice(words, k + 1, size(words) - k)").alias("rest"))
    cuts = cuts.join(known.select(F.col("words").alias("first"), F.col("f").alias("l")), "first").join(known.select(F.col("words").alias("rest"), F.col("f").alias("r")), "rest")
    lang = words.select(F.col("key").alias("_key"), "lang")
    cuts = cuts.withColumn("_key", F.col("words")[0]).join(lang, "_key").join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    top = (F.lit(1000).cast("decimal(4,0)") * (big("f") * big("total")).cast("decimal(34,0)")).cast("decimal(38,0)")
    cuts = cuts.withColumns({"top": top, "under": (big("l") * big("r")).cast("decimal(38,0)")})
    cuts = cuts.withColumn("score", F.expr("top div under"))
    best = cuts.groupBy("words").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("f").alias("a"), F.first("total").alias("n"), F.first("lang").alias("lang"))
    return best.select("words", "lang", "a", "c.l", "c.r", "n", "c.score")


def first_by_lang(rows: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language by score, occurrences and phrase, with the phrases' texts."""
    order = [F.desc("score"), F.desc("a")]
    # what is behind ``top`` others of its salted part by score and occurrences cannot be among the first; ties stay
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("words"), F.lit(SALTS))).orderBy(*order)
    some = stored(rows.withColumn("_r", F.rank().over(salted)).where(F.col("_r") <= top).drop("_r"), "first-phrases")
    texts = some.select("words", F.posexplode("words").alias("i", "key")).join(words.select("key", "word"), "key").groupBy("words").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"].cast("string")), " ").alias("phrase"))
    ranked = some.join(texts, "words").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of 2 to 5 words of each language.

    Whole texts are read three times, each time with less to shuffle: words are counted; then pairs of words that occur
    ``least`` times; then suffixes cut after DEPTH words and before a pair that does not, as no phrase over them can. What is
    frequent reaches the tasks as bitmaps of at most FILTER_MOST bits, which may let more through but drop nothing. The suffixes
    are combined to leaves, their prefixes grouped by a budget of leaves, and each group builds its truncated subtree by itself
    and reads the counts of phrases from the totals of leaves (``grouped``, ``phrase_counts``).

    Null texts are empty, a null lang is ``und``; repeated rows count as often as they come; doc_id and further columns are
    not read. An empty table gives no rows. Scores are exact (decimals of 38 digits).
    """
    rows, _ = set_aside(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(text_bytes(), F.lit(b""))))
    words = stored(word_counts(rows), "words")
    frequent = stored(words.where(F.col("n") >= least), "frequent-words")
    word_filter = make_filter(frequent, "key")
    pairs = stored(pair_counts(rows, word_filter).where(F.col("n") >= least), "frequent-pairs")
    pair_filter = make_filter(stored(_with_pair_key(pairs), "pair-keys"), "pair")
    found = stored(leaves(rows, word_filter, pair_filter), "leaves")
    two = pairs.select(F.array("w1", "w2").alias("words"), F.col("n").alias("f"))
    phrases = stored(two.unionByName(phrase_counts(found, least, budget)), "phrases")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("total")), "word-totals")
    return first_by_lang(stored(scored(phrases, frequent, totals, covered), "scored-phrases"), frequent, top)
