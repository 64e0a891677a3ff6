"""Language ID: script ranges narrow the candidates of a word, Viterbi over words labels the spans of a text."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm.kernels import mix, release

#: Documents of a language that the counts are learned from, on average at most; a language with more is thinned by id hash.
PER_LANG = 20_000
#: Languages that are learned at most: those of most documents. It bounds the model, 0.25 MB a language.
MAX_LANGS = 1_000
#: Buckets of character trigrams and whole words; what a script gets in letters is counted behind them.
BUCKETS = 1 << 16
#: Share of a language's letters that makes a script one of its scripts.
SCRIPT_SHARE = 0.01
#: What a change of language costs, in units of the per-word scores, and what a word that no candidate explains does.
SWITCH, FOREIGN = 6.0, 50.0
#: Added to every count; trigrams overlap, so the log likelihoods count half.
SMOOTH, SCALE = 0.1, 0.5
#: Characters worked on at a time.
GROUP_CHARS = 3_000_000

# Code point ranges of scripts (first, last, script); letters outside them are of script 0.
SCRIPTS = (
    (0x41, 0x24F, 1), (0x1E00, 0x1EFF, 1), (0x370, 0x3FF, 2), (0x1F00, 0x1FFF, 2), (0x400, 0x52F, 3), (0x530, 0x58F, 4), (0x590, 0x5FF, 5),
    (0x600, 0x77F, 6), (0x900, 0x97F, 7), (0x980, 0x9FF, 8), (0xA00, 0xA7F, 9), (0xB80, 0xBFF, 10), (0xC00, 0xC7F, 11), (0xE00, 0xE7F, 12),
    (0x10A0, 0x10FF, 13), (0x1100, 0x11FF, 14), (0xAC00, 0xD7AF, 14), (0x3040, 0x309F, 15), (0x30A0, 0x30FF, 16), (0x3400, 0x9FFF, 17),
    (0x20000, 0x323AF, 17))
N_SCRIPTS = 18
#: Scripts written without spaces: every letter is a word.
DENSE = (12, 15, 16, 17)
_LAST = 0x32400


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 0 no letter, 1 letter, 2 mark; lower case; script."""
    import unicodedata

    kind, lower, script = np.zeros(_LAST + 1, np.uint8), np.arange(_LAST + 1, dtype=np.uint32), np.zeros(_LAST + 1, np.uint8)
    for c in range(_LAST):
        s = chr(c)
        if s.isalpha():
            kind[c] = 1
            low = s.lower()
            lower[c] = ord(low) if len(low) == 1 else c
        elif c >= 0x300 and unicodedata.category(s)[0] == "M":
            kind[c] = 2
    for first, last, k in SCRIPTS:
        script[first : last + 1] = k
    return kind, lower, script


class TextWords(NamedTuple):
    """Words (runs of letters of one script) of some texts; row r owns words ``at[r]`` to ``at[r + 1]`` - 1."""

    at: np.ndarray
    start: np.ndarray  # code point offsets in the row
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    grams: np.ndarray  # buckets of all words, one after the other
    gram_at: np.ndarray


def text_words(texts: list[str]) -> TextWords:
    kind_of, lower_of, script_of = _tables()
    codes = np.minimum(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), _LAST)
    row_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    kind, script = kind_of[codes], script_of[codes]
    letter = kind == 1
    if len(codes):  # a mark goes on a word, with the script of what is before it
        inside = np.zeros(len(codes), bool)
        inside[row_at[:-1][row_at[:-1] < len(codes)]] = True  # here: first of a row
        opens = (kind > 0) & inside
        opens[1:] |= (kind[1:] > 0) & (kind[:-1] == 0)
        before = np.cumsum(letter) - letter  # letters before, less those before the run of letters and marks
        run = np.cumsum(opens) - 1
        first = letter & (before == before[np.flatnonzero(opens)][run]) if opens.any() else np.zeros(len(codes), bool)
        first[1:] |= letter[1:] & (script[1:] != script[:-1]) & (kind[:-1] == 1)
        first |= letter & np.isin(script, DENSE)
    else:
        first = letter
    starts = np.flatnonzero(first)
    part = kind > 0
    # the word a character belongs to is the last begun one, if nothing but letters and marks came between
    word = np.cumsum(first) - 1
    gap = np.cumsum(~part)
    row = np.searchsorted(row_at, np.arange(len(codes)), side="right") - 1 if len(codes) else np.empty(0, np.int64)
    mine = part & (word >= 0)
    mine[mine] = (gap[mine] == gap[starts[word[mine]]]) & (row[mine] == row[starts[word[mine]]])
    place, word = np.flatnonzero(mine), word[mine]
    n = np.bincount(word, minlength=len(starts))
    letters = np.bincount(word, weights=letter[mine], minlength=len(starts)).astype(np.int64)
    c = lower_of[codes[mine]].astype(np.uint64)
    at_word = np.cumsum(n) - n
    pos = np.arange(len(c)) - np.repeat(at_word, n)
    one, two = np.zeros(len(c), np.uint64), np.zeros(len(c), np.uint64)
    one[1:], two[2:] = c[:-1], c[:-2]
    one[pos < 1] = 0
    two[pos < 2] = 0
    mask = np.uint64(BUCKETS - 1)
    grams = mix(c | one << np.uint64(21) | two << np.uint64(42)) & mask
    if len(starts):
        last = at_word + n - 1
        ends = mix(c[last] << np.uint64(21) | one[last] << np.uint64(42) | np.uint64(1 << 20)) & mask
        whole = mix(np.add.reduceat(mix(c + pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at_word)) & mask
    else:
        ends = whole = np.empty(0, np.uint64)
    gram_at = np.concatenate([[0], np.cumsum(n + 2)])
    all_grams = np.empty(gram_at[-1], np.int64)
    all_grams[np.arange(len(c)) + 2 * word] = grams
    all_grams[gram_at[1:] - 2], all_grams[gram_at[1:] - 1] = ends, whole
    rows_of = row[starts]
    end = np.empty(len(starts), np.int64)
    end[word] = place + 1  # the last one stays
    return TextWords(np.searchsorted(starts, row_at), starts - row_at[rows_of], end - row_at[rows_of], letters, script[starts].astype(np.int64), all_grams, gram_at)


def _groups(column, size: int = GROUP_CHARS):
    """(first row, texts) of a string column, about ``size`` characters each; null is empty."""
    held, n, first = [], 0, 0
    for k, v in enumerate(column):
        t = v.as_py() or ""
        if held and n + len(t) > size:
            yield first, held
            held, n, first = [], 0, k
        held.append(t)
        n += len(t)
    if held:
        yield first, held


# -- learning --------------------------------------------------------------------------------------------------
class Model(NamedTuple):
    """``langs`` by falling number of documents learned from; log probabilities by bucket; which scripts a language has."""

    langs: tuple[str, ...]
    table: np.ndarray  # float32 [BUCKETS, langs]
    scripts: np.ndarray  # bool [N_SCRIPTS, langs]


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Counts of trigrams, words and scripts by language, of documents whose crc32(doc_id as text) mod 5 is not 0.

    The counts of a language have a fixed size, BUCKETS + N_SCRIPTS, whatever the corpus; they are summed by Spark. Rows with
    a null text or lang teach nothing; a null doc_id is one that is not held out. Without rows the model has no language.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        "text is not null and lang is not null").where(~F.coalesce(held_out("id"), F.lit(False)))
    number = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    thin = docs.sparkSession.createDataFrame([(x, min(1.0, per_lang / n)) for x, n in number.items()], "lang string, share double")
    some = known.join(F.broadcast(thin), "lang").where((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("share") * 1_000_000) | (F.col("share") == 1.0)).select("lang", "text")

    def count(batches):
        release(caches=True)
        held: dict[str, np.ndarray] = {}

        def out():
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, texts in _groups(batch.column(1)):
                w = text_words(texts)
                code = {x: i for i, x in enumerate(dict.fromkeys(langs[first : first + len(texts)]))}
                of_row = np.array([code[x] for x in langs[first : first + len(texts)]])
                of_word = np.repeat(of_row, np.diff(w.at))
                for lang, i in code.items():
                    mine = of_word == i
                    n = held.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                    n[:BUCKETS] += np.bincount(w.grams[np.repeat(mine, np.diff(w.gram_at))], minlength=BUCKETS)
                    n[BUCKETS:] += np.bincount(w.script[mine], weights=w.letters[mine], minlength=N_SCRIPTS).astype(np.int64)
                if len(held) > 64:
                    yield from out()
                    held.clear()
        yield from out()

    counts = some.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    langs = tuple(sorted(set(found["lang"]), key=lambda x: (-number[x], x)))
    full = np.zeros((BUCKETS + N_SCRIPTS, len(langs)))
    full[found["bucket"].to_numpy(np.int64), found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = found["n"]
    grams, scripts = full[:BUCKETS], full[BUCKETS:]
    table = np.log((grams + SMOOTH) / (grams.sum(axis=0) + SMOOTH * BUCKETS))
    return Model(langs, (SCALE * table).astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


# -- scoring ---------------------------------------------------------------------------------------------------
def word_scores(w: TextWords, model: Model) -> np.ndarray:
    """Score of every word in every language. Languages without the word's script fall FOREIGN behind the best that has it; a
    word of a script that no language has says nothing."""
    if not len(w.start):
        return np.zeros((0, len(model.langs)))
    raw = np.column_stack([np.add.reduceat(model.table[w.grams, k], w.gram_at[:-1], dtype=np.float64) for k in range(len(model.langs))])
    can = model.scripts[w.script]
    best = np.where(can, raw, -np.inf).max(axis=1, keepdims=True)
    return np.where(np.isfinite(best), np.where(can, raw - best, -FOREIGN), 0.0)


def viterbi(scores: np.ndarray, at: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best label of every word: scores summed, less ``penalty`` for each change within a row. Rows are worked on side by
    side, word by word; the last few long ones one after the other. Ties stay, else go to the lower label."""
    n, k = scores.shape
    labels = np.zeros(n, np.int64)
    if not n:
        return labels
    lens = np.diff(at)
    order = np.argsort(-lens, kind="stable")
    order = order[lens[order] > 0]
    begin, size = at[order], lens[order]
    stay, came = np.ones((n, k), bool), np.zeros(n, np.int64)
    value = scores[begin].copy()
    steps = int(size[0])
    few = int(size[3]) if len(size) > 3 else 0  # from here on at most three rows are left
    for t in range(1, few):
        a = int(np.searchsorted(-size, -t, side="left"))  # rows with more than t words
        idx, v = begin[:a] + t, value[:a]
        top = v.argmax(axis=1)
        out = v[np.arange(a), top][:, None] - penalty
        s = v >= out
        stay[idx], came[idx] = s, top
        value[:a] = np.where(s, v, out) + scores[idx]
    for r in range(min(3, len(size))):
        v = value[r].tolist()
        for t in range(max(few, 1), int(size[r])):
            i = int(begin[r]) + t
            best = max(v)
            out = best - penalty
            came[i] = v.index(best)
            gain = scores[i].tolist()
            if min(v) < out:
                stay[i] = [x >= out for x in v]
                v = [(x if x >= out else out) + g for x, g in zip(v, gain)]
            else:
                v = [x + g for x, g in zip(v, gain)]
        value[r] = v
    now = value.argmax(axis=1)
    labels[begin + size - 1] = now
    for r in range(min(3, len(size))):
        lab, lo = int(now[r]), int(begin[r])
        for i in range(lo + int(size[r]) - 1, lo + max(few, 1) - 1, -1):
            lab = lab if stay[i, lab] else int(came[i])
            labels[i - 1] = lab
        now[r] = lab
    for t in range(min(few, steps) - 1, 0, -1):
        a = int(np.searchsorted(-size, -t, side="left"))
        idx = begin[:a] + t
        lab = labels[idx]
        labels[idx - 1] = np.where(stay[idx, lab], lab, came[idx])
    return labels


SPANS = "array<struct<start: long, end: long, lang: string, letters: long, p: double>>"


def label(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans of every row of docs (doc_id, text).

    ``spans``: stretches of one language, first code point and the one behind the last, letters, and how likely the
    language is given the words of the span. ``lang_pred`` is the language of most letters (ties: of more training documents),
    ``score`` the letters' mean probability of it. ``und`` with score 0 and no spans if the text is null, empty or without a
    letter, or if nothing was learned. Every row is labelled by its own whole text: copies, equal and null ids stay as they
    are; other columns are not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release(caches=True)
        m = shared.value
        k = len(m.langs)
        for batch in batches:
            for first, texts in _groups(batch.column(1)):
                ids = batch.column(0).slice(first, len(texts))
                w = text_words(texts if k else [""] * len(texts))
                rows = len(texts)
                scores = word_scores(w, m)
                lab = viterbi(scores, w.at, switch)
                of = np.repeat(np.arange(rows), np.diff(w.at))
                new = np.ones(len(lab), bool)
                new[1:] = (lab[1:] != lab[:-1]) | (of[1:] != of[:-1])
                s = np.flatnonzero(new)
                span_row, span_lab = of[s], lab[s]
                pred, score, p = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(0)
                letters = np.zeros(0, np.int64)
                if len(s):
                    total = np.add.reduceat(scores, s, axis=0)
                    chance = np.exp(total - total.max(axis=1, keepdims=True))
                    chance /= chance.sum(axis=1, keepdims=True)
                    letters = np.add.reduceat(w.letters, s)
                    share = np.bincount(span_row * k + span_lab, weights=letters, minlength=rows * k).reshape(rows, k)
                    pred = share.argmax(axis=1)
                    p = chance[np.arange(len(s)), span_lab]
                    hits = np.bincount(span_row, weights=letters * chance[np.arange(len(s)), pred[span_row]], minlength=rows)
                    score = hits / np.maximum(share.sum(axis=1), 1)
                has = np.diff(w.at) > 0
                names = np.array([*m.langs, "und"], object)
                last = np.append(s[1:], len(lab)) - 1
                spans = pa.StructArray.from_arrays(
                    [pa.array(w.start[s]), pa.array(w.end[last] if len(s) else w.end[:0]), pa.array(names[span_lab], pa.string()), pa.array(letters), pa.array(p, pa.float64())],
                    ["start", "end", "lang", "letters", "p"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(span_row, np.arange(rows + 1)).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(names[np.where(has, pred, k)], pa.string()), pa.array(np.where(has, np.clip(score, 0, 1), 0.0)), lists], ["doc_id", "lang_pred", "score", "spans"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, lang_pred string, score double, spans {SPANS}")


def identify(docs: DataFrame, per_lang: int = PER_LANG, switch: float = SWITCH) -> DataFrame:
    """``label`` by a model learned from the rows of docs that are not held out, and which rows those are."""
    out = label(docs, fit(docs, per_lang), switch)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")

