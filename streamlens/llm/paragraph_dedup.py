"""Substring dedup: paragraphs that repeat across documents, found by MinHash bands and cut out but once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamlens.llm import kernels as K
from streamlens.llm.common import (
    SKETCH, block_counts, components, dropped, exchange, flat_values, joined_values, link_components, one_text_per_id, set_aside, shuffles_dropped, sketches, stored,
    text_bytes, verified)
from streamlens.llm.jaccard_join import choose_prefixes

#: Words of a paragraph, and starts among which one is chosen: every run of WORDS + SPAN - 1 = 50 words holds a paragraph.
WORDS, SPAN = 35, 16
SHINGLE = 5
#: Words of the keeper's text that are looked at on either side of a paragraph's ends; more than a run without a paragraph has.
AROUND = 64
#: A paragraph with fewer different 5-word shingles says a few words over and over; its long runs say nothing. Its bands are
#: ROWS MinHash values each of the 5-word shingles, and FEW_BANDS of them, as there are only few such paragraphs: similarities
#: of 0.75 and 0.86 meet with probability .957 and .9998, those of 1/11 (the same run, then another word) hardly ever.
FEW, ROWS, FEW_BANDS = 16, 6, 16
#: All other paragraphs: NEAR_BANDS bands of NEAR_ROWS MinHash values each of the 5-word shingles. Similarities of 0.75, 0.77
#: (27 of 35) and 1 meet with probability .963, .974 and 1, wherever in the paragraphs the difference is; 0.3 with .15.
NEAR_ROWS, NEAR_BANDS = 3, 6
_NEAR = np.random.default_rng(57).integers(1, 1 << 63, NEAR_ROWS * NEAR_BANDS, dtype=np.uint64) | np.uint64(1)
_ROW = np.random.default_rng(31).integers(1, 1 << 63, ROWS * FEW_BANDS, dtype=np.uint64) | np.uint64(1)
#: Bands side by side, 6 bytes each.
_PACK = np.dtype((np.void, 6 * NEAR_BANDS))
#: Inverse of the base of ``K._powers``, and its powers: hashes of runs are differences of running sums.
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (of each row)."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[..., :-step], out[..., step:])
        done += step
    return out


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of runs of ``n`` that begin at ``first``, one run after the other."""
    return np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)


def paragraph_starts(shingle: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of the paragraphs of texts side by side, which begin and end at ``at``: of every SPAN consecutive starts of a text the
    one whose first shingle hash is least (the last of equals). The choice depends on those words alone, so a run of words -
    wherever it was pasted - is cut alike."""
    first, n = at[:-1], np.diff(at) - WORDS + 1
    salt, out = np.uint64(0x5851F42D4C957F2D), []
    many = n > SPAN
    if many.any():
        # packing the place into the low bits finds the last of equals with the minimum itself
        low = np.uint64((1 << 20) - 1)
        place = low - (np.arange(len(shingle), dtype=np.uint64) & low)
        best = _sliding_min((K.mix(shingle ^ salt) & ~low) | place, SPAN)
        window = _runs(first[many], n[many] - SPAN + 1)
        start = window + ((place[window] - best[window]) & low).astype(np.int64)  # distance from the window's first start
        out.append(start[np.concatenate([[True], start[1:] != start[:-1]])])
    few = (n > 0) & ~many
    if few.any():
        start, n = _runs(first[few], n[few]), n[few]
        h, edge = K.mix(shingle[start] ^ salt), np.cumsum(n) - n
        least = np.repeat(np.minimum.reduceat(h, edge), n)
        out.append(np.maximum.reduceat(np.where(h == least, start, -1), edge))
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


def variety(shingle: np.ndarray, starts: np.ndarray, width: int, at: np.ndarray = np.zeros(1, np.int64)) -> np.ndarray:
    """Different shingles among the ``width`` from each start on: those that did not come before inside the paragraph. ``at``: where
    the texts begin."""
    order = np.argsort(shingle)
    held = shingle[order]
    again = held[1:] == held[:-1]
    if not again.any():
        return np.full(len(starts), width)
    place = np.sort(order[np.concatenate([again, [False]]) | np.concatenate([[False], again])])
    order = place[np.argsort(shingle[place], kind="stable")]
    before, here = order[:-1], order[1:]
    low = np.maximum(here - width + 1, at[np.searchsorted(at, here, side="right") - 1])
    both = (shingle[before] == shingle[here]) & (before >= low)
    # paragraphs that start from low to before hold both
    less = np.bincount(low[both], minlength=len(shingle) + 1) - np.bincount(before[both] + 1, minlength=len(shingle) + 1)
    return width - np.cumsum(less)[starts]


def identities(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Identity hashes of the pieces at ``starts``; the words' order is part of them."""
    n = len(words)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * K._powers(n)[:n], dtype=np.uint64)])
    return K.mix((total[starts + WORDS] - total[starts]) * _back(n)[starts])


def _back(n: int, _held: list = [np.ones(1, np.uint64)]) -> np.ndarray:
    if n > len(_held[0]):
        _held[0] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(1 << n.bit_length(), _BACK, np.uint64)]))
    return _held[0]


def few_bands(shingle: np.ndarray, starts: np.ndarray, some: slice = slice(None)) -> np.ndarray:
    """Band hashes of the pieces at ``starts``, one row for each of ``some`` of FEW_BANDS."""
    width = WORDS - SHINGLE + 1
    ends = np.bincount(starts, minlength=len(shingle) + 1)[: len(shingle)] - np.bincount(starts + width, minlength=len(shingle) + 1)[: len(shingle)]
    inside = np.cumsum(ends) > 0
    at = (np.cumsum(inside) - 1)[starts]  # their places among the shingles that are inside one
    kinds, kind = np.unique(shingle[inside], return_inverse=True)
    out = []
    for b in range(FEW_BANDS)[some]:
        mixed = np.full(len(starts), b + 101, np.uint64)
        for r in range(ROWS):
            mixed = K.mix(mixed + _least(K.mix(kinds * _ROW[ROWS * b + r])[kind], at, width))
        out.append(mixed)
    return np.stack(out)


def _least(h: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each start on."""
    half = 1 << (width.bit_length() - 1)  # two runs of this length cover the width
    runs = _sliding_min(h, half)
    return np.minimum(runs[starts], runs[starts + width - half])


def paragraphs(words: np.ndarray):
    """(starts, identity hashes, band hashes, number of the paragraph of each band hash) of one text's word hashes. Only those of
    few shingles have bands here, and those of a few more that could link with them; see ``near_bands``."""
    s = K.shingle_hashes(words, SHINGLE)
    starts = paragraph_starts(s, np.array([0, len(words)]))
    if not len(starts):
        return starts, np.empty(0, np.uint64), np.empty(0, np.uint64), starts
    few = np.flatnonzero(75 * variety(s, starts, WORDS - SHINGLE + 1) < 100 * FEW)
    bands = few_bands(s, starts[few]).ravel() if len(few) else np.empty(0, np.uint64)
    return starts, identities(words, starts), bands, np.tile(few, FEW_BANDS)


def near_bands(shingle: np.ndarray, starts: np.ndarray, line: np.ndarray | None = None, n: np.ndarray | None = None,
               some: slice = slice(None)) -> np.ndarray:
    """Band hashes of the pieces at ``starts`` and then of the lines of ``n`` words at ``line``, one row for each of ``some`` of
    NEAR_BANDS; ``shingle``: the 5-word shingles of a text, or of texts side by side."""
    lines, width = 0 if line is None else len(line), WORDS - SHINGLE + 1
    edges = np.stack([line, line + n - SHINGLE + 1], axis=1).ravel() if lines else None
    pad = bool(lines) and edges[-1] == len(shingle)
    mixed, h, spare = [], np.empty(len(shingle), np.uint64), np.empty(len(shingle), np.uint64)
    for band in np.arange(NEAR_BANDS)[some]:
        m = np.full(len(starts) + lines, 201 + band, np.uint64)
        for value in _NEAR[NEAR_ROWS * band : NEAR_ROWS * (band + 1)]:
            K.mix_into(np.multiply(shingle, value, out=h), spare)
            low = []
            if lines:
                low.append(np.minimum.reduceat(np.append(h, h[-1]) if pad else h, edges)[::2])
            if len(starts):
                low.insert(0, _least(h, starts, width))
            if low:
                m = K.mix(m + np.concatenate(low))
        mixed.append(m)
    return np.stack(mixed)


def _packed(bands: np.ndarray) -> np.ndarray:
    """The band hashes of NEAR_BANDS rows, one packed value a column."""
    raw = np.ascontiguousarray(bands.T).view(np.uint8).reshape(bands.shape[1], NEAR_BANDS, 8)[:, :, :6]
    return np.ascontiguousarray(raw).reshape(bands.shape[1], -1).view(_PACK).ravel()


def _unpacked(column: pa.Array, bands: slice = slice(None)) -> np.ndarray:
    """Band hashes, all or some of the NEAR_BANDS of each packed value, in its order. The six bytes that travelled are spread anew."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, NEAR_BANDS, 6)[:, bands].reshape(-1, 6)
    low = np.zeros((len(raw), 8), np.uint8)
    low[:, :6] = raw
    return K.mix(low.view(np.uint64).ravel() ^ np.uint64(0x2545F4914F6CDD1D))


def lines(words: np.ndarray, at: np.ndarray, breaks: np.ndarray, shortest: int = SHINGLE, text: np.ndarray = np.zeros(1, np.int64)):
    """(starts, numbers of words, identity hashes) of the lines of ``shortest`` words or more of texts side by side; ``at``: byte
    offsets of the words, ``breaks``: those of the line feeds, ``text``: where texts begin."""
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64), words
    number = np.searchsorted(breaks, at)
    new = np.concatenate([[True], number[1:] != number[:-1]])
    new[text[text < len(words)]] = True
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(words)))
    place = np.arange(len(words)) - np.repeat(first, n)
    same = K.mix(np.add.reduceat(words * K._powers(int(n.max()))[place], first))
    keep = n >= max(shortest, SHINGLE)
    return first[keep], n[keep], same[keep]


#: Words of the texts that are hashed side by side; a longer text is alone.
SIDE_BY_SIDE = 1 << 15


class Texts(NamedTuple):
    """Texts side by side: rows ``first`` and on of a batch."""

    first: int
    at: np.ndarray  # words at which they begin, and the end
    words: np.ndarray
    starts: np.ndarray  # byte offsets of the words
    breaks: np.ndarray  # and of the line feeds

    def shingles(self) -> np.ndarray:
        """One for every word; the last four of a text are no shingles of it."""
        return K.shingle_hashes(np.concatenate([self.words, np.zeros(SHINGLE - 1, np.uint64)]), SHINGLE)


def _texts(column: pa.Array) -> Iterator[Texts]:
    for words in K.batch_words(column, lower=True):
        breaks, row, rows = np.flatnonzero(words.data == 10), 0, words.last - words.first
        while row < rows:
            end = max(row + 1, int(np.searchsorted(words.at, words.at[row] + SIDE_BY_SIDE, side="right")) - 1)
            end = min(end, rows)
            own = slice(words.at[row], words.at[end])
            if own.stop > own.start:
                yield Texts(words.first + row, words.at[row : end + 1] - own.start, words.hashes[own], words.starts[own], breaks)
            row = end


def _of_texts(batch: pa.RecordBatch, shortest: int):
    """For texts side by side of a batch (doc_id, text): where they begin, their shingles, the starts of their pieces, their lines'
    starts and numbers of words, and what names them all: identities, doc_ids, starts in the text, sizes and codes. A code is, with doc_id,
    an address: twice the start, and one more for lines of other than WORDS words."""
    ids = batch.column(0).to_numpy()
    for t in _texts(batch.column(1)):
        s = t.shingles()
        starts = paragraph_starts(s, t.at)
        line, n, named = lines(t.words, t.starts, t.breaks, shortest, t.at)
        same = np.concatenate([identities(t.words, starts), named])
        size = np.concatenate([np.full(len(starts), WORDS), n]).astype(np.int32)
        place = np.concatenate([starts, line])
        row = np.searchsorted(t.at, place, side="right") - 1
        start = (place - t.at[row]).astype(np.int32)
        yield t.at, s, starts, line, n, same, ids[t.first + row], start, size, start * 2 + (size != WORDS)


def _units(docs: DataFrame, shortest: int) -> DataFrame:
    """(node, doc_id, start, size, code, shared): every occurrence of a paragraph that occurs more than once. ``shared``: in several
    documents. A line that is the piece at its place as well is one occurrence."""
    def emit(batch):
        for *_, same, doc, start, size, _ in _of_texts(batch, shortest):
            yield same, doc, start, size

    def receive(columns):
        columns = _not_alone(columns)
        if not len(columns[0]):
            return
        order = np.lexsort((columns[2], columns[1], columns[0]))
        same, doc, start, size = (c[order] for c in columns)
        edge = np.concatenate([[True], same[1:] != same[:-1]])
        new = edge | (doc != np.roll(doc, 1)) | (start != np.roll(start, 1))
        same, doc, start, size, edge = (c[new] for c in (same, doc, start, size, edge))
        first, group = np.flatnonzero(edge), np.cumsum(edge) - 1
        shared = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first))[group]
        keep = np.flatnonzero((np.diff(np.append(first, len(edge))) > 1)[group])
        for k in np.array_split(keep, 1 + len(keep) // 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(same[k].view(np.int64)), pa.array(doc[k]), pa.array(start[k]), pa.array(size[k]), pa.array(start[k] * 2 + (size[k] != WORDS)), pa.array(shared[k])],
                ["node", "doc_id", "start", "size", "code", "shared"])

    return exchange(docs, emit, receive, (np.uint64, np.int64, np.int32, np.int32), "node long, doc_id long, start int, size int, code int, shared boolean")


def _not_alone(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The rows whose first value, a hash, comes again; most do not, and need no further order."""
    def again(held, order):
        alone = np.concatenate([[True], held[1:] != held[:-1], [True]])[: len(held) + 1]
        return order[~(alone[1:] & alone[:-1])]

    # 32 bits, dealt by 16 at a time, tell nearly all of them
    held = columns[0].astype(np.uint32)
    order = np.argsort(held.astype(np.uint16), kind="stable")
    order = order[np.argsort((held >> np.uint32(16)).astype(np.uint16)[order], kind="stable")]
    order = again(held[order], order)
    order = order[np.argsort(columns[0][order], kind="stable")]
    order = again(columns[0][order], order)
    return [c[order] for c in columns]


def _buckets(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, code) of the first occurrence of every paragraph that shares a band with a different paragraph of another document,
    once for each such band. Within a band 32 bits tell paragraphs apart."""
    def emit(batch):
        for at, s, starts, line, n, same, doc, _, _, code in _of_texts(batch, shortest):
            kinds = variety(s, starts, WORDS - SHINGLE + 1, at) if len(starts) else starts
            many, some = np.flatnonzero(kinds >= FEW), np.flatnonzero(75 * kinds < 100 * FEW)
            held = [(near_bands(s, starts[many], line, n), np.concatenate([many, len(starts) + np.arange(len(line))]).astype(np.int64))]
            if len(some):  # a few words over and over are the same pieces over and over
                _, one, every = np.unique(same[some], return_index=True, return_inverse=True)
                held.append((few_bands(s, starts[some[one]])[:, every], some))
            for bands, which in held:
                if bands.size:
                    which = np.tile(which, len(bands))
                    yield bands.ravel(), same[which].astype(np.uint32), doc[which], code[which].astype(np.int32)

    def receive(columns):
        columns = _not_alone(columns)
        order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
        band, same, doc, code = (c[order] for c in columns)
        if not len(band):
            return
        edge = np.concatenate([[True], band[1:] != band[:-1]])
        lead = edge | np.concatenate([[True], same[1:] != same[:-1]])
        first, group = np.flatnonzero(edge), np.cumsum(edge) - 1
        several = np.add.reduceat(lead.astype(np.int64), first) > 1
        keep = lead & (several & (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)))[group]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(code[keep])], ["doc_id", "code"])

    return exchange(docs, emit, receive, (np.uint64, np.uint32, np.int64, np.int32), "doc_id long, code int")


#: Shingles of a block of sets; a block's range of hashes should not be small against what else it costs.
SET_BLOCK = 1 << 19


def _sets(docs: DataFrame, leads: DataFrame, shortest: int) -> DataFrame:
    """(block, hashes, n, doc_id, special, node, owner, start, size, once): words and shingles of one occurrence of every
    paragraph of ``leads`` (node, doc_id, code, owner, shared, once), read from its text once more. A row holds a block of them as arrays:
    ``hashes`` has the ``n`` different shingles of each, in order, ``special`` is ``shared``."""
    wanted = leads.groupBy("doc_id").agg(F.collect_list(F.struct("code", "node", "owner", "shared", "once")).alias("units"))
    names = ["block", "hashes", "n", "doc_id", "special", "node", "owner", "start", "size", "once"]

    def block(held):
        hashes, special, doc, node, owner, start, size, n, once = (np.concatenate(c) for c in zip(*held))
        columns = (hashes, n, doc, special, node, owner, start, size, once)
        return pa.RecordBatch.from_arrays([pa.array([int(node[0])]), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names)

    def sets(batches):
        K.release(caches=True)
        held, total = [], 0
        for batch in batches:
            ids, ends = batch.column(0).to_numpy(), np.asarray(batch.column(2).offsets)
            units = batch.column(2).values
            code, node, owner = (units.field(k).to_numpy() for k in range(3))
            shared, once = (units.field(k).to_numpy(zero_copy_only=False).astype(np.uint8) for k in (3, 4))
            for t in _texts(batch.column(1)):
                s, rows = t.shingles(), len(t.at) - 1
                own = slice(ends[t.first], ends[t.first + rows])
                row = np.repeat(np.arange(rows), np.diff(ends[t.first : t.first + rows + 1]))
                start, long = (code[own] >> 1).astype(np.int64), code[own] & 1 == 1
                at, size = start + t.at[row], np.full(len(start), WORDS)
                if long.any():
                    line, n, _ = lines(t.words, t.starts, t.breaks, shortest, t.at)
                    size[long] = n[np.searchsorted(line, at[long])]
                # the different shingles of each, in order
                n = size - SHINGLE + 1
                of, x = np.repeat(np.arange(len(n)), n), s[_runs(at, n)]
                usual = n == WORDS - SHINGLE + 1
                inside = usual[of]
                x[inside] = np.sort(x[inside].reshape(-1, WORDS - SHINGLE + 1), axis=1).ravel()
                x[~inside] = (y := x[~inside])[np.lexsort((y, of[~inside]))]
                new = np.concatenate([[True], (x[1:] != x[:-1]) | (of[1:] != of[:-1])])[: len(x)]
                n = np.bincount(of[new], minlength=len(n))
                held.append((x[new], shared[own], ids[t.first + row], node[own], owner[own], start.astype(np.int32), size.astype(np.int32), n, once[own]))
                total += int(n.sum())
                if total >= SET_BLOCK:
                    yield block(held)
                    held, total = [], 0
        if total:
            yield block(held)
        del held
        K.release()

    kinds = ", ".join(f"{c} {'long' if c == 'block' else 'binary'}" for c in names)
    return docs.join(wanted, "doc_id").select("doc_id", "text", "units").mapInArrow(sets, kinds)


def _arrays(batch: pa.RecordBatch, r: int, kinds: dict) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(batch.schema.get_field_index(c))[r].as_buffer(), k) for c, k in kinds.items()]


def _alone(sets: DataFrame) -> DataFrame:
    """(node, doc_id, start, size): those paragraphs of ``sets`` that occur once only."""
    def emit(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                *columns, once = _arrays(batch, r, {"node": np.int64, "doc_id": np.int64, "start": np.int32, "size": np.int32, "once": np.uint8})
                yield pa.RecordBatch.from_arrays([pa.array(c[once == 1]) for c in columns], ["node", "doc_id", "start", "size"])

    return sets.select("node", "doc_id", "start", "size", "once").mapInArrow(emit, "node long, doc_id long, start int, size int")


def _rarest_first(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, owner, items, prefix, ell) of the paragraphs of ``sets`` of which other documents have enough to link: the shingles that
    any one of another document has, and the rarest of them (see ``choose_prefix``). (Neighbours in a text share much with each other, and
    a few words over and over share long runs with much that is no copy of them.)"""
    def choose(batches):
        K.release(caches=True)
        for batch in batches:
            for r in range(batch.num_rows):
                df, x, node, owner, n = _arrays(batch, r, {"df": np.uint16, "hashes": np.uint64, "node": np.int64, "owner": np.int64, "n": np.int64})
                of = np.repeat(np.arange(len(n)), n)
                m = np.bincount(of[df > 0], minlength=len(n))
                enough = (100 * m >= percent * n) & (m > 0)
                keep = (df > 0) & enough[of]
                df, x, of = df[keep], x[keep], of[keep]
                node, owner, n, m = (c[enough] for c in (node, owner, n, m))
                # by sets, counts and hashes, which are in order already
                order = np.lexsort((df.astype(np.uint64) << np.uint64(48) | x >> np.uint64(16), of))
                ell, size = choose_prefixes(df[order], m, n, percent)
                for k in np.array_split(np.arange(len(n)), 1 + len(n) // 10_000):
                    if len(k):
                        at = np.cumsum(m) - m
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(node[k]), pa.array(n[k]), pa.array(owner[k]), joined_values(x[_runs(at[k], m[k])], m[k]),
                             joined_values(x[order[_runs(at[k], size[k])]], size[k]), pa.array(ell[k].astype(np.int32))],
                            ["node", "n", "owner", "items", "prefix", "ell"])
        K.release()

    return block_counts(sets.select("block", "hashes", "n", F.col("doc_id").alias("of"), "special", "node", "owner")).mapInArrow(
        choose, "node long, n long, owner long, items binary, prefix binary, ell int")


#: Members of a bucket of which all pairs are looked at. Larger ones are contracted first.
ALL_PAIRS = 128


def _met(some: DataFrame, percent: int) -> DataFrame:
    """(a, b, n, ell, m, pos, sketch): pairs of paragraphs that share a bucket of at most ALL_PAIRS members and may link, by the
    conditions of ``link_components``; the rest is null. And the members of larger buckets: a is the bucket, b the paragraph."""
    def emit(batch):
        node, n, owner, ell = (batch.column(i).to_numpy() for i in (0, 1, 2, 5))
        items, ends = flat_values(batch.column(3), np.uint64)
        prefix, at = flat_values(batch.column(4), np.uint64)
        if not len(prefix):
            return
        m, size = np.diff(ends), np.diff(at)
        place = np.arange(len(prefix)) - np.repeat(at[:-1], size) + np.repeat(n - m, size)  # unique ones come first
        bits = sketches(items, ends[:-1])
        yield (prefix, *(np.repeat(c, size) for c in (node, owner)), *(np.repeat(c, size).astype(np.int32) for c in (n, m, ell)), place.astype(np.int32),
               *(np.repeat(b, size) for b in bits))

    def receive(columns):
        columns = _not_alone(columns)
        if not len(columns[0]):
            return
        edge = np.concatenate([[True], columns[0][1:] != columns[0][:-1]])
        first = np.flatnonzero(edge)
        k = np.diff(np.append(first, len(edge)))
        bucket, node, owner, n, m, ell, pos, *bits = columns
        bits = [b.view(np.uint64) for b in bits]
        out = []
        for size in np.unique(k[k <= ALL_PAIRS]):
            i, j = np.triu_indices(size, 1)
            of = first[k == size]
            for some in np.array_split(of, 1 + len(of) * len(i) // 500_000):
                a, b = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                both = percent * (n[a] + n[b])
                may = (owner[a] != owner[b]) & ((100 + percent) * np.minimum(m[a], m[b]) >= both)
                may &= (100 + percent) * (np.minimum(n[a] - pos[a], n[b] - pos[b]) + np.minimum(ell[a], ell[b]) - 1) >= both
                a, b = a[may], b[may]
                apart = n[a] - m[a] + n[b] - m[b]
                for x in bits:
                    apart = apart + np.bitwise_count(x[a] ^ x[b])
                may = (100 + percent) * apart <= (100 - percent) * (n[a] + n[b])
                out.append(np.stack([node[a[may]], node[b[may]]]))
        if out:
            pairs = np.sort(np.concatenate(out, axis=1), axis=0)
            pairs = pairs[:, np.lexsort(pairs)]
            pairs = pairs[:, np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])[: pairs.shape[1]]]
            none = [pa.nulls(pairs.shape[1], pa.int64())] * 8
            yield pa.RecordBatch.from_arrays([*map(pa.array, pairs), *none], names)
        large = np.flatnonzero(np.repeat(k > ALL_PAIRS, k))
        for some in np.array_split(large, 1 + len(large) // 10_000):
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(c[some].view(np.int64) if c.itemsize == 8 else c[some].astype(np.int64)) for c in (bucket, node, n, ell, m, pos, *bits)], names)

    names = ["a", "b", "n", "ell", "m", "pos", *SKETCH]
    kinds = (np.uint64, np.int64, np.int64, *[np.int32] * 4, *[np.int64] * len(SKETCH))
    return exchange(some.select("node", "n", "owner", "items", "prefix", "ell"), emit, receive, kinds, ", ".join(f"{c} long" for c in names))


def _linked(some: DataFrame, percent: int) -> DataFrame:
    """(node, component) for the graph of all pairs of ``some`` (see ``_rarest_first``) that link. Nodes in no link are left out."""
    met = stored(_met(some, percent), "paragraph-met")
    pairs = stored(met.where("n is null").select("a", "b").distinct(), "paragraph-pairs")
    large = met.where("n is not null").withColumnsRenamed({"a": "bucket", "b": "node"})
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
    sets = stored(some.select("node", "n", "items", "owner").join(nodes, "node", "left_semi"), "paragraph-some")
    dropped(some)
    edges = stored(verified(pairs, sets, percent), "paragraph-edges")
    labels = stored(components(edges, "paragraph-star"), "paragraph-labels")
    dropped(pairs, edges)
    if not large.isEmpty():
        labels = stored(link_components(large, sets, percent, "paragraphs", few=5_000_000, labels=labels), "paragraph-linked")
    dropped(met, sets)
    return labels


def repeats(docs: DataFrame, percent: int = 75, shortest: int = WORDS) -> DataFrame:
    """(doc_id, start_word, n_words, component_id, keeper): paragraphs that repeat in another document, one row each.

    A paragraph is a line of ``shortest`` (SHINGLE at least) words or more, or a piece: WORDS consecutive words (between ASCII white space, A-Z
    lower-cased) from a start that its own words choose, so pasted passages are found inside longer lines and every repeat
    of 50 words is. Two paragraphs of different documents link if they
    are equal, or each shares a band with another paragraph and their 5-word shingle sets have a Jaccard similarity of percent / 100
    or more, exactly verified; component_id names a component of links, keeper its smallest doc_id. Lines of fewer words are no paragraph;
    nulls have none; rows with a null doc_id are left out; see ``one_text_per_id`` for repeated ids. Paragraphs that repeat
    inside one document only are not reported, and paragraphs of one document do not link with each other.

    Equal paragraphs meet by their identity, and only those that occur more than once are kept; of the bands, only those that different
    paragraphs share are kept. The paragraphs that have one meet by the rarest of their shingles (``_rarest_first``), so variants of one passage meet only if they share what sets them apart. Every step's shuffle files and tables go when the
    next step's table is written.
    """
    docs = one_text_per_id(docs).select("doc_id", text_bytes().alias("text"))
    with shuffles_dropped(docs.sparkSession, small=True):
        buckets = stored(_buckets(docs, shortest), "paragraph-buckets")
        units = stored(_units(docs, shortest), "paragraph-units")
        named = buckets.select("doc_id", "code").distinct().join(units.select("doc_id", "code", "node", "shared"), ["doc_id", "code"], "left")
        once = F.col("node").isNull()
        named = named.select("doc_id", "code", F.coalesce("node", F.xxhash64("doc_id", "code")).alias("node"), F.coalesce("shared", F.lit(False)).alias("shared"), once.alias("once"))
        named = stored(named, "paragraph-names")
        leads = named.groupBy("node").agg(F.min(F.struct("doc_id", "code")).alias("l"), F.first("shared").alias("shared"), F.first("once").alias("once"))
        owner = F.when(F.col("shared"), F.xxhash64("node", F.lit(1))).otherwise(F.col("l.doc_id")).alias("owner")
        sets = stored(_sets(docs, leads.select("node", "l.doc_id", "l.code", owner, "shared", "once"), shortest), "paragraph-sets")
        dropped(buckets, named)
        alone = stored(_alone(sets), "paragraph-alone")
        # only what other documents have enough of can link
        some = stored(_rarest_first(sets, percent), "paragraph-shared")
        dropped(sets)
        linked = _linked(some, percent)
        where = units.join(linked, "node", "left").where("shared or component is not null").select("doc_id", "start", "size", F.coalesce("component", "node").alias("component_id"))
        where = stored(where.union(alone.join(linked, "node").select("doc_id", "start", "size", "component")), "paragraph-components")
        dropped(units, alone, linked)
        # stored, so that the join's sides are both shuffled and Spark can split a component with much of the rows
        groups = where.groupBy("component_id").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("high"))
        groups = stored(groups.where("keeper <> high").drop("high"), "paragraph-groups")
    return where.join(groups, "component_id").select("doc_id", F.col("start").alias("start_word"), F.col("size").alias("n_words"), "component_id", "keeper")


#: A word of a keeper's text on its way: 48 bits of its hash.
_SHORT, _LOW = np.dtype((np.void, 6)), np.uint64((1 << 48) - 1)


def _shortened(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)[:, :6]).view(_SHORT).ravel()


def _restored(short: np.ndarray) -> np.ndarray:
    words = np.zeros((len(short), 8), np.uint8)
    words[:, :6] = short.view(np.uint8).reshape(-1, 6)
    return words.view(np.uint64).ravel()


def _agree(a: np.ndarray, at: np.ndarray, b: np.ndarray, there: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """For each pair of places in ``a`` and ``b``, how many values from there on, ``most`` at most, are equal; ``step``: -1 or 1."""
    out, k, live = np.zeros(len(at), np.int64), 0, np.flatnonzero(most > 0)
    while len(live):
        live = live[a[at[live] + step * k] == b[there[live] + step * k]]
        k += 1
        out[live] = k
        live = live[most[live] > k]
    return out


def _met_at(shingle: np.ndarray, at: np.ndarray, n: np.ndarray, held: np.ndarray, first: np.ndarray, size: np.ndarray, place: np.ndarray, last: bool):
    """Of each paragraph's ``n`` shingles from ``at`` on, the first (or last) that is among the ``size`` of ``held`` from ``first`` on, and its
    place there that is nearest to where the paragraphs' places differ as much as ``place`` from ``at``: (distances from ``at`` and ``first``; -1
    where there is none)."""
    i = n - 1 if last else np.zeros(len(at), np.int64)
    j = place + i
    inside = (j >= 0) & (j < size)
    same = inside & (shingle[at + i] == held[first + np.where(inside, j, 0)])
    rest = np.flatnonzero(~same)
    for some in np.array_split(rest, 1 + len(rest) // 256):
        if not len(some):
            continue
        x, y = np.arange(int(n[some].max())), np.arange(int(size[some].max()))
        mine = shingle[np.minimum(at[some, None] + x, len(shingle) - 1)]
        real = y < size[some, None]
        eq = mine[:, :, None] == held[first[some, None] + np.where(real, y, 0)][:, None, :]  # filled up with the first, which is there
        met = eq.any(axis=2) & (x < n[some, None])
        k = met.shape[1] - 1 - met[:, ::-1].argmax(axis=1) if last else met.argmax(axis=1)
        rows = np.arange(len(some))
        far = np.where(eq[rows, k] & real, np.abs(y - (place[some] + k)[:, None]), 1 << 30)
        none = ~met.any(axis=1)
        i[some], j[some] = np.where(none, -1, k), np.where(none, -1, far.argmin(axis=1))
    return i, j


def _extended(t: Texts, shingle: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, left: tuple, right: tuple, before: np.ndarray, after: np.ndarray):
    """(first words, ends) of paragraphs, widened while the text agrees with their keepers'. ``left``: the keepers' words around
    the first of their paragraphs, which has the place ``before``; ``right``: those around their ends, ``after`` of them behind it; a side
    that is not widened has none. Both as one array, and where each paragraph's words begin and the last end."""
    end, near = start + n, np.minimum(n, AROUND)
    a, b = start.copy(), end.copy()
    low, high = t.at[row], t.at[row + 1]
    for (words, ends), back in ((left, True), (right, False)):
        size = np.diff(ends)
        some = np.flatnonzero(size)
        if not len(some):
            continue
        first, size = ends[some], size[some]
        held = K.shingle_hashes(np.concatenate([words, np.zeros(SHINGLE - 1, np.uint64)]), SHINGLE)
        at = start[some] if back else end[some] - near[some]
        place = before[some] if back else size - after[some] - near[some]
        i, j = _met_at(shingle, at, near[some] - SHINGLE + 1, held, first, size - SHINGLE + 1, place, not back)
        met = i >= 0
        some, here, there, size, j = some[met], (at + i)[met], (first + j)[met], size[met], j[met]
        if back:
            a[some] = np.minimum(a[some], here - _agree(t.words, here - 1, words, there - 1, np.minimum(here - low[some], j), -1))
        else:
            b[some] = np.maximum(b[some], here + _agree(t.words, here, words, there, np.minimum(high[some] - here, size - j), 1))
    return a - low, b - low


def whole_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (see ``repeats``) with start_word and n_words of paragraphs that are not their keeper's widened both ways, word
    by word, while the text agrees with the keeper's, AROUND words at most: longer agreement has paragraphs of its own there.

    Paragraphs that touch and are equally far from their places in one keeper are a run; only its first is widened to the left and its
    last to the right, as the others end inside the run. Null and repeated ids, null texts and empty tables as in ``repeats``.
    """
    docs = one_text_per_id(docs).select("doc_id", text_bytes().alias("text"))
    with shuffles_dropped(docs.sparkSession, small=True):
        found = stored(found, "paragraph-found")
        kept = found.where("doc_id = keeper").groupBy("component_id").agg(F.min(F.struct("start_word", "n_words")).alias("k"))
        # stored, so that Spark can split a component with much of the rows
        kept = stored(kept.select("component_id", F.col("k.start_word").alias("at"), F.col("k.n_words").alias("size")), "paragraph-kept")
        end = F.col("start_word") + F.col("n_words")
        line = Window.partitionBy("doc_id", "keeper", "shift").orderBy("start_word", "n_words", "component_id")
        placed = found.where("doc_id > keeper").join(kept, "component_id").withColumn("shift", F.col("start_word") - F.col("at"))
        placed = placed.withColumn("head", F.coalesce(F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1)) < F.col("start_word"), F.lit(True)))
        placed = placed.withColumn("run", F.sum(F.col("head").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
        placed = placed.withColumn("tail", end == F.max(end).over(Window.partitionBy("doc_id", "keeper", "shift", "run")))
        placed = stored(placed.drop("shift", "run"), "paragraph-runs")
        ends = placed.where("head or tail")
        units = ends.groupBy("component_id").agg(F.first("keeper").alias("doc_id"), F.first("at").alias("at"), F.first("size").alias("size"))
        units = units.groupBy("doc_id").agg(F.collect_list(F.struct("component_id", "at", "size")).alias("units"))

        def windows(batches):
            K.release(caches=True)
            for batch in batches:
                ends, units = np.asarray(batch.column(1).offsets), batch.column(1).values
                component, first, size = (units.field(k).to_numpy() for k in range(3))
                for t in _texts(batch.column(0)):
                    rows = len(t.at) - 1
                    own = slice(ends[t.first], ends[t.first + rows])
                    row = np.repeat(np.arange(rows), np.diff(ends[t.first : t.first + rows + 1]))
                    at, n = first[own] + t.at[row], size[own].astype(np.int64)
                    near, lo, hi = np.minimum(n, AROUND), np.maximum(t.at[row], at - AROUND), np.minimum(t.at[row + 1], at + n + AROUND)
                    sides = [joined_values(_shortened(t.words[_runs(x, y - x)]), y - x) for x, y in ((lo, at + near), (at + n - near, hi))]
                    yield pa.RecordBatch.from_arrays([pa.array(component[own]), *sides, pa.array((at - lo).astype(np.int32)), pa.array((hi - at - n).astype(np.int32))],
                                                     ["component_id", "left", "right", "before", "after"])

        around = docs.join(units, "doc_id").select("text", "units").mapInArrow(windows, "component_id long, left binary, right binary, before int, after int")
        around = stored(around, "paragraph-windows")
        cut = ends.join(around, "component_id").select(
            "doc_id", F.struct("start_word", "n_words", "component_id", "keeper", F.when(F.col("head"), F.col("left")).alias("left"),
                               F.when(F.col("tail"), F.col("right")).alias("right"), "before", "after").alias("unit"))
        cut = cut.groupBy("doc_id").agg(F.collect_list("unit").alias("units"))

        def widen(batches):
            K.release(caches=True)
            for batch in batches:
                ids, ends, units = batch.column(0).to_numpy(), np.asarray(batch.column(2).offsets), batch.column(2).values
                start, n, component, keeper, before, after = (units.field(k).to_numpy() for k in (0, 1, 2, 3, 6, 7))
                for t in _texts(batch.column(1)):
                    t = t._replace(words=t.words & _LOW)
                    rows = len(t.at) - 1
                    lo, hi = ends[t.first], ends[t.first + rows]
                    own, row = slice(lo, hi), np.repeat(np.arange(rows), np.diff(ends[t.first : t.first + rows + 1]))
                    sides = (flat_values(units.field(k).slice(lo, hi - lo), _SHORT) for k in (4, 5))
                    left, right = ((_restored(words), at) for words, at in sides)
                    a, b = _extended(t, t.shingles(), row, start[own] + t.at[row], n[own].astype(np.int64), left, right, before[own].astype(np.int64), after[own].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[t.first + row]), pa.array(a.astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(component[own]), pa.array(keeper[own])],
                                                     ["doc_id", "start_word", "n_words", "component_id", "keeper"])
            K.release()

        wide = docs.join(cut, "doc_id").select("doc_id", "text", "units").mapInArrow(widen, "doc_id long, start_word int, n_words int, component_id long, keeper long")
        wide = stored(wide, "paragraph-wide")
        dropped(around, kept)
    names = wide.columns
    return found.where("doc_id = keeper").select(*names).unionByName(placed.where("not head and not tail").select(*names)).unionByName(wide)


def removed_spans(found: DataFrame) -> DataFrame:
    """(doc_id, spans): for every document the word ranges [start, end) to cut, merged where they touch: its paragraphs whose
    component has a keeper of smaller doc_id."""
    cut = found.where("doc_id > keeper").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct(F.col("start_word").alias("a"), (F.col("start_word") + F.col("n_words")).alias("b")))).alias("p"))
    merged = F.expr("""aggregate(p, cast(array() as array<struct<a:int,b:int>>), (acc, x) ->
      if(size(acc) > 0 and element_at(acc, -1).b >= x.a,
         concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, x.b)))),
         concat(acc, array(x))))""")
    return cut.select("doc_id", merged.alias("spans"))


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the ranges; the white space before a cut stays."""
    edge = np.diff(np.concatenate([[0], (~K._WHITE[np.frombuffer(text, np.uint8)]).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if spans[-1][1] > len(starts):
        return text
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = int(ends[b - 1])
    out.append(text[at:])
    return b"".join(out)


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with every repeated paragraph cut out of all documents but its keeper; n_chars, if there, is counted anew. Rows
    without a cut are unchanged, and so is a text too short for its cuts (another text of a repeated doc_id). Columns may have
    any names."""
    kinds = {f.name: f.dataType for f in docs.schema}
    rows, back = set_aside(docs)
    of = {n: c for c, n in back.items()}
    spans = removed_spans(found)

    @F.pandas_udf("string")
    def cut(text: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([cut_words(bytes(t), [(x["a"], x["b"]) for x in c]).decode("utf-8", "replace") for t, c in zip(text, cuts)])

    joined = rows.join(spans, F.col(of["doc_id"]).cast("long") == F.col("doc_id"), "left")
    to_cut = F.col("spans").isNotNull() & F.col(of["text"]).isNotNull()
    hit = joined.where(to_cut).withColumn(of["text"], cut(text_bytes(of["text"]), F.col("spans")))
    if "n_chars" in of:
        hit = hit.withColumn(of["n_chars"], F.length(of["text"]).cast(kinds["n_chars"]))
    return joined.where(~to_cut).select(*back).unionByName(hit.select(*back)).toDF(*back.values())
