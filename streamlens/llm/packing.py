"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm.common import text_bytes
from streamlens.llm.kernels import release
from streamlens.llm.tokens import _forget, chunks, vocabulary_path, word_ids

#: Tokens that are packed together; bounds a task's memory.
WINDOW_TOKENS = 2_000_000
#: Pieces that a task hands on at a time: 2 MB of ids at most, which the JVM holds beside the worker.
PIECES = 256


def cost(n, linear: float = 1.0, quadratic: float = 1 / 4096):
    """Estimated work of a piece of ``n`` tokens in a model: a linear part and attention, quadratic in the piece."""
    return linear * n + quadratic * n * n


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(piece of document, start, length, sequence, offset) for documents of ``lengths`` tokens.

    A document over the capacity first gives its full sequences. With F full sequences left in the rest, the descending
    rests each go whole to the sequence of least estimated cost that has room for them; what finds no room whole is cut
    into the largest rooms, so these F sequences end exactly full. The last tokens, fewer than the capacity, make sequences
    of decreasing powers of two. Nothing is padded.
    """
    out, rests, sequence = [], [], 0
    for d, n in enumerate(lengths):
        n, start = int(n), 0
        while n - start >= capacity:
            out.append((d, start, capacity, sequence, 0))
            sequence += 1
            start += capacity
        if n > start:
            rests.append((n - start, d, start))
    rests.sort(key=lambda x: (-x[0], x[1]))
    full = sum(r[0] for r in rests) // capacity
    room, load = np.full(full, capacity, np.int64), np.zeros(full)
    left = []
    for n, d, start in rests:
        free = np.flatnonzero(room >= n)
        if not len(free):
            left.append((n, d, start))
            continue
        s = int(free[np.argmin(load[free])])
        out.append((d, start, n, sequence + s, capacity - int(room[s])))
        room[s] -= n
        load[s] += cost(n)
    holes = [(int(s), int(room[s])) for s in np.argsort(-room, kind="stable") if room[s] > 0]
    k, last = 0, []
    for n, d, start in left:
        while n:
            if k == len(holes):
                last.append((n, d, start))
                break
            s, space = holes[k]
            take = min(n, space)
            out.append((d, start, take, sequence + s, capacity - space))
            n, start = n - take, start + take
            if take == space:
                k += 1
            else:
                holes[k] = (s, space - take)
    sequence += full
    spare = sum(n for n, _, _ in last)
    at, space = 0, 0
    for n, d, start in last:
        while n:
            if not space:
                space = 1 << (spare.bit_length() - 1)
                spare -= space
                at = 0
                sequence += 1
            take = min(n, space)
            out.append((d, start, take, sequence - 1, at))
            n, start, at, space = n - take, start + take, at + take, space - take
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end: int = 1, window: int = WINDOW_TOKENS) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): one row per piece of a document in a sequence.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers; ``end`` closes every document, so a null or
    empty text is one token. Rows are packed each for itself, repeated or not; a null doc_id stays null. Other columns
    are ignored; an empty table gives no rows.

    Packing needs no shuffle: every partition packs windows of about ``window`` tokens, each without padding (see
    ``pack_lengths``); a sequence is named by partition and number, so a task that runs again makes the same rows.
    """
    path = vocabulary or vocabulary_path()

    def run(batches):
        release(caches=True, but=_forget)
        coder, base = word_ids(path), TaskContext.get().partitionId() << 36
        held, total, made = [], 0, 0

        def close(held, made):
            lengths = np.concatenate([n for _, n, _ in held])
            doc = [i for ids, _, _ in held for i in ids]
            tokens = np.concatenate([t for _, _, t in held])
            first = np.concatenate([[0], np.cumsum(lengths)])
            rows = pack_lengths(lengths, capacity)
            d, start, length, seq, offset = (np.array(c, np.int64) for c in zip(*rows))
            for lo in range(0, len(d), PIECES):
                o = slice(lo, lo + PIECES)
                blob = [tokens[first[a] + s : first[a] + s + n].astype("<u4").tobytes() for a, s, n in zip(d[o], start[o], length[o])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc[k] for k in d[o]], pa.int64()), pa.array(start[o]), pa.array(length[o]), pa.array(lengths[d[o]]),
                     pa.array(seq[o] + made + base), pa.array(offset[o]), pa.array(blob, pa.binary())], names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, texts in chunks(batch.column(1)):
                tokens, n = coder.encode(texts, end)
                held.append((ids[row : row + len(texts)], n, tokens))
                total += len(tokens)
                if total >= window:
                    yield from close(held, made)
                    made, held, total = made + total, [], 0
        if held:
            yield from close(held, made)
        del held
        release()

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = ", ".join(f"{c} long" for c in names[:-1]) + ", ids binary"
    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, schema)
