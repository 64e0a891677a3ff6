"""N-gram Jaccard self-join of documents by adaptive multi-match prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm import kernels as K
from streamlens.llm.common import SKETCH, exchange, link_components, one_text_per_id, sketches, stored, text_bytes

#: Longest extension of a prefix that is weighed.
MAX_ELL = 8


def choose_prefix(df: np.ndarray, n: int, percent: int, max_ell: int = MAX_ELL) -> tuple[int, int]:
    """(ell, tokens of ``df`` in the prefix) for a set of ``n`` tokens of which those in ``df`` (document frequencies,
    ascending) occur elsewhere; the others come first in the order and meet nothing.

    Two sets that link share at least ceil(percent / 100 * n) tokens, so their first n - that + ell tokens share ell. With a
    partner of equal size, which asks for a larger intersection and so needs a shorter part of the prefix, that part meets
    S(ell) entries of other sets, of which at most S(ell) / ell can share ell tokens and have to be verified at a cost of
    about n: the ell of least S + S / ell * n / 16 is taken.
    """
    least = -(-percent * n // 100)
    unique = n - len(df)
    ell = np.arange(1, max_ell + 1)
    upto = np.clip(n - least + ell - unique, 0, len(df))
    equal = np.clip(n - -(-2 * percent * n // (100 + percent)) + ell - unique, 0, len(df))
    met = np.concatenate([[0], np.cumsum(df - 1)])[equal].astype(float)
    ok = ell <= max(1, least)
    cost = np.where(ok, met + met / ell * (n / 16), np.inf)
    best = int(np.argmin(cost))
    return best + 1, int(upto[best])


def choose_prefixes(df: np.ndarray, m: np.ndarray, n: np.ndarray, percent: int, max_ell: int = MAX_ELL) -> tuple[np.ndarray, np.ndarray]:
    """``choose_prefix`` for many sets at once: of ``n`` tokens each, of which ``m`` occur elsewhere, their frequencies one set after
    the other in ``df``."""
    least, unique = -(-percent * n // 100), n - m
    at = np.cumsum(m) - m
    total = np.concatenate([[0], np.cumsum(df.astype(np.int64) - 1)])
    best, ell, size = np.full(len(n), np.inf), np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
    for k in range(1, max_ell + 1):
        upto = np.clip(n - least + k - unique, 0, m)
        equal = np.clip(n - -(-2 * percent * n // (100 + percent)) + k - unique, 0, m)
        met = (total[at + equal] - total[at]).astype(float)
        cost = np.where(k <= np.maximum(1, least), met + met / k * (n / 16), np.inf)
        less = (cost < best) | (k == 1)
        best, ell, size = np.where(less, cost, best), np.where(less, k, ell), np.where(less, upto, size)
    return ell, size


def prefixes(shared: DataFrame, percent: int, max_ell: int = MAX_ELL, name: str = "shared", least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Sets with their prefixes (node, n, items, prefix, ell), stored, and the ``members`` that ``link_components`` takes, of ``shared``
    (node, token, df, n): the tokens that several sets have, with their frequencies and the whole size of the set. Sets of
    which fewer than ``least`` percent are such tokens are left out."""
    ordered = shared.repartition("node").sortWithinPartitions("node", "df", "token")

    def gather(batches):
        node, n, token, df, out = None, 0, [], [], []

        def close():
            t = np.concatenate(token).view(np.uint64)
            d = np.concatenate(df)
            if 100 * len(t) < least * n:
                return
            ell, size = choose_prefix(d, n, percent, max_ell)
            out.append((node, n, np.sort(t).tobytes(), t[:size].tobytes(), ell))

        for batch in batches:
            at, tok, fr, size = (batch.column(i).to_numpy() for i in range(4))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]]) if len(at) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if at[lo] != node:
                    if node is not None:
                        close()
                    node, n, token, df = int(at[lo]), int(size[lo]), [], []
                token.append(tok[lo:hi].copy())
                df.append(fr[lo:hi].copy())
                if len(out) >= 1000:
                    yield rows(out)
                    out.clear()
        if node is not None:
            close()
        if out:
            yield rows(out)
        K.release()

    def rows(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32()))],
            ["node", "n", "items", "prefix", "ell"])

    arrays = stored(ordered.select("node", "token", "df", "n").mapInArrow(gather, "node long, n long, items binary, prefix binary, ell int"), name)

    def unfold(batches):
        for batch in batches:
            prefix = [np.frombuffer(batch.column(2)[i].as_buffer(), np.int64) for i in range(batch.num_rows)]
            size = np.array([len(p) for p in prefix])
            if size.sum():
                items = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(5)]
                bits = sketches(np.concatenate(items), np.cumsum([0, *map(len, items[:-1])]))
                held = [np.repeat(batch.column(c).to_numpy(), size) for c in (0, 1, 3, 4)]
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + held[1] - held[3]  # unique ones come first
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefix)), *map(pa.array, held), pa.array(place), *(pa.array(np.repeat(b, size)) for b in bits)],
                                                 ["bucket", "node", "n", "ell", "m", "pos", *SKETCH])

    m = F.expr("cast(length(items) / 8 as bigint)")
    members = arrays.where(F.length("prefix") > 0).select("node", "n", "prefix", "ell", m.alias("m"), "items").mapInArrow(
        unfold, "bucket long, node long, n long, ell int, m long, pos long, " + ", ".join(f"{c} long" for c in SKETCH))
    return arrays, members


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 75, max_ell: int = MAX_ELL) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of the links 100 * |A & B| >= percent * |A | B| between the sets of
    distinct ``k``-word shingles (words between ASCII white space, A-Z lower-cased).

    A text with fewer than ``k`` words is one shingle; a text without words, or null, has none and links with nothing. Rows
    with a null doc_id have no identity and are left out. Repeated rows count once; of several texts of one id the greatest
    counts. Other columns are ignored. An empty table gives no rows.

    Equal sets are one node from the start. A shuffle of shingle hashes finds each hash's document frequency; hashes of one
    document drop out there. With the order (frequency, hash) each set then takes the prefix that ``choose_prefix`` weighs
    best, and two sets are verified if their prefixes share min(ell) tokens: the shorter of both extensions is contained in
    the longer, so linked sets always do.
    """
    docs = one_text_per_id(docs).select("doc_id", text_bytes().alias("text"))

    def profile(batches):
        K.release(caches=True)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            n = np.zeros(len(ids), np.int64)
            hi, lo = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for words in K.batch_words(batch.column(1), lower=True):
                for row, h in K.distinct_shingles(words, k):
                    n[row] = len(h)
                    if len(h):
                        hi[row], lo[row] = K.signature(h)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(hi), pa.array(lo)], ["doc_id", "n", "hi", "lo"])
        K.release()

    sets = stored(docs.mapInArrow(profile, "doc_id long, n long, hi long, lo long"), "profiles")
    classes = stored(sets.where("n > 0").groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("node")), "classes")

    def emit(batch):
        ids = batch.column(0).to_numpy()
        # equal sets of a batch are sent once: the hot group shrinks before the shuffle
        where, held = {}, []
        for words in K.batch_words(batch.column(1), lower=True):
            for row, h in K.distinct_shingles(words, k):
                if len(h):
                    sig = (len(h), *K.signature(h))
                    if sig in where and ids[held[where[sig]][0]] <= ids[row]:
                        continue
                    if sig in where:
                        held[where[sig]] = (row, h)
                    else:
                        where[sig] = len(held)
                        held.append((row, h))
            if sum(len(h) for _, h in held) > 500_000:
                yield flat(held, ids)
                where, held = {}, []
        if held:
            yield flat(held, ids)

    def flat(held, ids):
        lens = np.array([len(h) for _, h in held])
        return np.concatenate([h for _, h in held]), np.repeat(ids[[r for r, _ in held]], lens)

    def receive(columns):
        hashes, ids = columns
        order = np.argsort(hashes, kind="stable")
        hashes, ids = hashes[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        count = np.diff(np.concatenate([first, [len(hashes)]]))
        df = np.repeat(count, count)
        many = df > 1
        if many.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[many]), pa.array(hashes[many].view(np.int64)), pa.array(df[many].astype(np.int32))], ["node", "token", "df"])

    shared = exchange(docs, emit, receive, (np.uint64, np.int64), "node long, token long, df int")
    shared = shared.join(classes.select("node", "n"), "node")  # other copies of a set have done their part in the counts
    arrays, members = prefixes(shared, percent, max_ell, "shared")
    linked = link_components(members, arrays.select("node", "n", "items"), percent, "ngrams")
    named = classes.join(linked, "node", "left").select("n", "hi", "lo", F.coalesce("component", "node").alias("component_id"))
    some = sets.where("n > 0").join(named, ["n", "hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(sets.where("n = 0").select("doc_id", "n", "doc_id"))


def keep_one(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """Documents without those whose component has a smaller doc_id. A row without a doc_id stays; rows that repeat a kept
    doc_id stay as they are."""
    drop = linked.where("doc_id <> component_id").select("doc_id").withColumnRenamed("doc_id", "__dropped")
    return docs.join(drop, docs["doc_id"] == drop["__dropped"], "left_anti")
