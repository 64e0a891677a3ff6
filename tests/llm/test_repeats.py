"""Paragraph dedup: planted passages, exactness of links, cuts."""

import random

import numpy as np
import pytest

from streamlens.llm import kernels as K
from streamlens.llm import paragraph_dedup as P


def prose(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def planted(seed=0):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (50, 55, 64, 90)]
    short = prose(rng, 13)  # a line of many documents, too short to be a paragraph
    docs, holds = [], {}
    for i in range(120):
        words = prose(rng, rng.randrange(5, 150))
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = short
        if i % 4 == 0:
            p = rng.randrange(4)
            at = rng.randrange(len(words) + 1)
            words[at:at] = passages[p]
            holds[i] = p
        docs.append((i, " ".join(w + ("\n" if rng.random() < 0.1 else "") for w in words)))
    return docs, holds


def test_planted_passages_are_found_and_nothing_else(spark):
    docs, holds = planted()
    found = P.repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in found} == set(holds)
    keeper = {p: min(d for d, q in holds.items() if q == p) for p in set(holds.values())}
    assert all(holds[r.keeper] == holds[r.doc_id] and r.keeper <= r.doc_id for r in found)
    cut = {r.doc_id for r in found if r.doc_id > r.keeper}
    assert cut == set(holds) - set(keeper.values())


def test_every_run_of_fifty_words_holds_a_paragraph():
    rng = np.random.default_rng(1)
    for trial in range(60):
        run = rng.integers(0, 1 << 62, 50, dtype=np.uint64) if trial % 2 else rng.integers(0, 4, 50, dtype=np.uint64)
        held = []
        for _ in range(2):
            before, after = (rng.integers(0, 1 << 62, int(rng.integers(0, 60)), dtype=np.uint64) for _ in range(2))
            w = np.concatenate([before, run, after])
            starts, same, _, _ = P.paragraphs(w)
            inside = (starts >= len(before)) & (starts + P.WORDS <= len(before) + 50)
            assert inside.any()
            held.append(set(same[inside].tolist()))
        assert held[0] & held[1]


def test_links_are_exact(spark):
    """Every reported component is connected by links of at least 0.75, and equal paragraphs are always together."""
    rng = random.Random(4)
    base = prose(rng, 60)
    docs = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(prose(rng, 10) + words + prose(rng, 10))))
    found = P.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    text = {d: t.split() for d, t in docs}
    groups = {}
    for r in found:
        w = text[r.doc_id][r.start_word : r.start_word + r.n_words]
        groups.setdefault(r.component_id, set()).add(tuple(w))
    seen = [w for g in groups.values() for w in g]
    assert len(seen) == len(set(seen)) and found
    for g in groups.values():
        sets = [frozenset(zip(*(w[k:] for k in range(5)))) for w in g]
        reached, queue = {0}, [0]
        for a in queue:
            for b in range(len(sets)):
                if b not in reached and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    reached.add(b)
                    queue.append(b)
        assert len(reached) == len(sets)


def test_a_few_words_over_and_over_meet_by_what_they_are():
    w, x, y, z = (np.full(P.WORDS, k, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in (1, 1, 1, 1))
    x[33:], y[:2] = np.uint64(77), np.uint64(99)  # runs of one word, ended by another word or begun by a third
    assert P.variety(K.shingle_hashes(x, 5), np.array([0]), 31)[0] == 3
    a, b, c, d = (P.paragraphs(v)[2] for v in (w, x, y, z))
    assert len(a) == P.FEW_BANDS and (a == d).all() and not np.isin(a, b).any() and not np.isin(b, c).any()


def test_near_bands_meet_at_the_threshold_wherever_the_words_differ():
    """Halves in the other order: 27 of 35 shingles in common, but no 31 words in a row. And cycles of 20 words: few shingles."""
    rng = np.random.default_rng(3)
    met = total = 0
    for trial in range(600):
        w = rng.integers(0, 1 << 62, P.WORDS, dtype=np.uint64)
        k = int(rng.integers(5, 31))
        v = np.concatenate([w[k:], w[:k]])
        a, b = (K.shingle_hashes(x, 5) for x in (w, v))
        assert len(np.intersect1d(a, b)) == 27
        total += 1
        met += bool((P.near_bands(a, np.array([0])) == P.near_bands(b, np.array([0]))).any())
    assert met / total >= 0.95


def test_rotated_halves_are_linked(spark):
    rng = random.Random(8)
    docs = []
    for i in range(40):
        w = prose(rng, P.WORDS)
        k = rng.randrange(8, 28)
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[k:] + w[:k]))]
    found = P.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    pairs = {r.doc_id for r in found if r.doc_id % 2}
    assert len(pairs) >= 36 and all(r.keeper == r.doc_id // 2 * 2 for r in found)


def test_lines_are_compared_whole(spark):
    """Long lines with scattered edits, against brute force, and short lines that are equal."""
    rng = random.Random(9)
    docs, links = [], 0
    for i in range(40):
        w = prose(rng, 100)
        v = list(w)
        v[33], v[67] = prose(rng, 2)
        a, b = (set(zip(*(x[k:] for k in range(5)))) for x in (w, v))
        links += 100 * len(a & b) >= 75 * len(a | b)
        docs += [(2 * i, "\n".join([" ".join(prose(rng, 7)), " ".join(w)])), (2 * i + 1, "\n".join([" ".join(v), " ".join(prose(rng, 7))]))]
    line = " ".join(prose(rng, 6))
    docs += [(100 + i, "\n".join([" ".join(prose(rng, 9)), line, " ".join(prose(rng, 3))])) for i in range(5)]
    found = P.repeats(spark.createDataFrame(docs, "doc_id long, text string"), shortest=P.SHINGLE).collect()
    assert links == 40
    whole = {r.doc_id for r in found if r.doc_id < 100 and r.n_words == 100 and r.keeper == r.doc_id // 2 * 2}
    assert len({d for d in whole if d % 2}) >= 0.95 * links
    assert sorted((r.doc_id, r.start_word, r.n_words, r.keeper) for r in found if r.doc_id >= 100) == [(100 + i, 9, 6, 100) for i in range(5)]


def test_cut(spark):
    docs, holds = planted(1)
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars int")
    out = P.without_repeats(df, P.repeats(df))
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    after = {r.doc_id: r for r in out.collect()}
    assert len(after) == len(docs)
    for d, t in docs:
        r = after[d]
        if d not in holds or d == min(x for x, q in holds.items() if q == holds[d]):
            assert r.text == t
        else:
            gone = len(t.split()) - len(r.text.split())
            assert P.WORDS <= gone <= 100 and r.n_chars == len(r.text)
            assert set(r.text.split()) <= set(t.split())
    assert not [r for r in P.repeats(out).collect() if r.doc_id > r.keeper]


def test_whole_repeats_are_cut(spark):
    """Nothing of a pasted passage stays but in its keeper; besides it go at most 8 words at either end: 4 by which a linked
    piece may differ, and 4 more by which another piece of the same text is linked to that one."""
    rng = random.Random(11)
    passages = [prose(rng, n) for n in (50, 51, 60, 77, 100)]
    docs, want = [], {}
    for i in range(60):
        a, b = prose(rng, rng.randrange(60, 99)), prose(rng, rng.randrange(60, 99))
        docs.append((i, " ".join(a + passages[i % 5] + b)))
        want[i] = a, b
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = P.whole_spans(df, P.repeats(df, shortest=P.SHINGLE))
    after = {r.doc_id: r.text.split() for r in P.without_repeats(df, found).collect()}
    for i, (a, b) in want.items():
        if i < 5:
            assert after[i] == a + passages[i] + b
        else:
            assert not set(after[i]) & set(passages[i % 5])
            assert set(a[:-8] + b[8:]) <= set(after[i])


def test_cut_words():
    assert P.cut_words("a b  ç d\ne f".encode(), [(1, 3)]).decode() == "a  d\ne f"
    assert P.cut_words(b"a b", [(0, 2)]) == b"" and P.cut_words(b"a b", [(1, 9)]) == b"a b"


def test_edge_rows(spark):
    same = " ".join(f"q{i}" for i in range(60))
    huge = " ".join(f"h{i}" for i in range(40_000))
    rows = [(1, None, 1), (2, "", 1), (3, "few words", 1), (4, same, 1), (5, same.upper(), 1), (None, same, 1), (6, "tick " * 500, 1), (7, huge, 1), (8, huge, 1), (8, huge, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    found = P.repeats(df).collect()
    assert {r.doc_id for r in found} == {4, 5, 7, 8}
    after = sorted(((r.doc_id, len((r.text or "").split())) for r in P.without_repeats(df, P.repeats(df)).collect()), key=repr)
    want = {1: 0, 2: 0, 3: 2, 4: 60, 6: 500, 7: 40_000, None: 60}
    assert all(n == want[d] for d, n in after if d in want)
    assert all(n <= 40 for d, n in after if d in (5, 8)) and len(after) == len(rows)
    assert P.repeats(df.limit(0)).collect() == [] and P.without_repeats(df.limit(0), P.repeats(df.limit(0))).collect() == []


def test_near_bands_meet_at_the_threshold_in_lines():
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(600):
        w = rng.integers(0, 1 << 62, 74, dtype=np.uint64)
        v = w.copy()
        v[[20, 50]] = rng.integers(0, 1 << 62, 2, dtype=np.uint64)
        a, b = (K.shingle_hashes(x, 5) for x in (w, v))
        assert len(np.intersect1d(a, b)) == 60  # of 80
        none, first, n = np.empty(0, np.int64), np.array([0]), np.array([74])
        met += bool((P.near_bands(a, none, first, n) == P.near_bands(b, none, first, n)).any())
    assert met / 600 >= 0.94


def test_packed_bands_come_back_one_to_one():
    rng = np.random.default_rng(6)
    bands = rng.integers(0, 1 << 62, (P.NEAR_BANDS, 40), dtype=np.uint64)
    bands[:, 20:] = bands[:, :20]
    import pyarrow as pa
    out = P._unpacked(pa.array([bytes(x) for x in P._packed(bands)], pa.binary())).reshape(40, P.NEAR_BANDS)
    assert (out[:20] == out[20:]).all() and len(np.unique(out)) == 20 * P.NEAR_BANDS


def test_long_texts_have_the_bands_of_short_ones():
    s = np.random.default_rng(7).integers(0, 1 << 62, 70_000, dtype=np.uint64)
    starts = np.array([5, 60_000])
    assert (P.near_bands(s, starts) == np.concatenate([P.near_bands(s[:100], starts[:1]), P.near_bands(s[59_900:], np.array([100]))], axis=1)).all()


def test_paragraphs_of_one_document_do_not_link(spark):
    """A in document 1; A' and a line that is like A' only in document 2: the latter is clean and stays."""
    rng = random.Random(12)
    docs = []
    for i in range(20):
        w = prose(rng, 74)
        v, x = list(w), list(w)
        v[20], v[50] = prose(rng, 2)
        x[20], x[50] = v[20], v[50]
        x[30], x[60] = prose(rng, 2)
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v) + "\n" + " ".join(x))]
    found = P.repeats(spark.createDataFrame(docs, "doc_id long, text string"), shortest=P.SHINGLE).where("n_words = 74").collect()
    assert sum(r.start_word == 0 and r.doc_id % 2 for r in found) >= 17
    assert not [r for r in found if r.doc_id % 2 and r.start_word == 74]


def test_names_that_clash_and_rows_of_all_kinds(spark):
    same = " ".join(f"q{i}" for i in range(60))
    rows = [(1, same, 1, 2, 3), (2, "a b\n" + same, 1, 2, 3), (2, "a b\n" + same, 1, 2, 3), (3, None, 1, 2, 3), (4, "", 1, 2, 3), (None, same, 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id int, __spans int, spans int")
    whole = P.whole_spans(df, P.repeats(df, shortest=P.SHINGLE))
    assert {(r.doc_id, r.keeper) for r in whole.collect()} == {(1, 1), (2, 1)}
    out = P.without_repeats(df, whole)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, None if r.text is None else r.text.strip()) for r in out.collect()), key=repr)
    assert got == sorted([(1, same), (2, "a b"), (2, "a b"), (3, None), (4, ""), (None, same)], key=repr)
    empty = df.limit(0)
    assert P.whole_spans(empty, P.repeats(empty)).collect() == []


def test_runs_are_widened_at_their_ends(spark):
    """Long passages, two of them with an edit inside, are cut whole and no clean word with them."""
    rng = random.Random(13)
    passage = prose(rng, 300)
    docs = []
    for i in range(12):
        w = list(passage)
        if i in (4, 7):
            w[150] = prose(rng, 1)[0]
        docs.append((i, " ".join(prose(rng, 40) + w + prose(rng, 40))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = P.whole_spans(df, P.repeats(df, shortest=P.SHINGLE))
    after = {r.doc_id: r.text.split() for r in P.without_repeats(df, found).collect()}
    text = {d: t.split() for d, t in docs}
    for i in range(1, 12):
        left = set(after[i]) & set(passage)
        assert not left or i in (4, 7)
        assert set(text[i][:32] + text[i][-32:]) <= set(after[i])


def test_variants_that_do_not_link_are_told_before_they_are_compared(spark, monkeypatch):
    """Each edit is in two documents, so every shingle is shared; variants of different edits are no links, and few are compared."""
    from streamlens.llm import common as C
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in rng.integers(0, 10**9, 60)]
    texts = []
    for k in range(60):
        t = list(base)
        t[5 + k % 12], t[20 + k % 11], t[36 + k % 13], t[50] = f"a{k}", f"b{k}", f"c{k}", f"d{k}"
        texts += [" ".join(t), " ".join(t) + " end"]
    compared, before = [], C.verified

    def verified(pairs, sets, percent):
        compared.append(pairs.count())
        return before(pairs, sets, percent)

    monkeypatch.setattr(C, "verified", verified)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.keeper for r in P.repeats(docs, shortest=5).collect()} == set(range(0, 120, 2))
    assert sum(compared) < 3 * 120


def test_only_what_occurs_again_is_kept_between_steps(spark):
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 10**9, 80)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:1])), "doc_id long, text string").selectExpr("doc_id", "cast(text as binary) as text")
    kept = P._units(docs, 5)
    assert {r.doc_id for r in kept.collect()} == {0, 20} and "bands" not in kept.columns


def odd_texts():
    rng = random.Random(21)
    line = prose(rng, 12)
    texts = ["", "one two", "tick " * 300, " ".join(f"h{i}" for i in range(47)), "a b\n" * 90, " ".join(prose(rng, 35)), "x y z " * 20 + "\n" + "q " * 35]
    for i in range(80):
        words = prose(rng, rng.randrange(200))
        texts.append(" ".join(words[:60] + line + words[60:]) + ("\n" + " ".join(line)) * (i % 3))
    return [None, *texts, " ".join(prose(rng, 40_000))]


def test_texts_side_by_side_are_what_they_are_alone(monkeypatch):
    """And hashing them takes calls by what they hold, not by how many they are."""
    import pyarrow as pa
    calls, mix = [], K.mix
    monkeypatch.setattr(K, "mix", lambda h: calls.append(len(h)) or mix(h))
    texts = odd_texts()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t if t is None else t.encode() for t in texts], pa.binary())], ["doc_id", "text"])

    def named(batch):
        out = set()
        for at, s, starts, line, n, same, doc, start, size, code in P._of_texts(batch, P.SHINGLE):
            kinds = P.variety(s, starts, P.WORDS - P.SHINGLE + 1, at)
            bands = np.concatenate([P.near_bands(s, starts, line, n), np.tile(np.concatenate([kinds, n]).astype(np.uint64), (1, 1))])
            out |= set(zip(doc.tolist(), same.tolist(), start.tolist(), size.tolist(), code.tolist(), map(tuple, bands.T.tolist())))
        return out

    side = named(batch)
    together = len(calls)
    alone = set().union(*(named(batch.slice(k, 1)) for k in range(len(texts))))
    assert side == alone and {d for d, *_ in side} > {3, 4, 6, len(texts) - 1}
    assert together < 200 < len(calls) / 5
    for d, text in enumerate(texts):  # and the pieces of each are those of its words
        words = next(K.batch_words(batch.column(1).slice(d, 1), lower=True)).hashes
        starts, same, _, _ = P.paragraphs(words)
        kinds = [len(set(K.shingle_hashes(words, 5)[k : k + 31].tolist())) for k in starts]
        held = {(x[2], x[1], x[5][-1]) for x in side if x[0] == d and x[3] == P.WORDS}
        assert {(a, b, c) for a, b, c in zip(starts.tolist(), same.tolist(), kinds)} <= {(a, b, c if c < 35 else 31) for a, b, c in held} | held


def test_widened_as_one_by_one():
    """Against a plain version: the first (last) shingle that the keeper has, at the nearest place, and from there on word by word."""
    rng = np.random.default_rng(14)

    def plain(words, start, n, left, right, before, after):
        shingle, end = [tuple(words[k : k + 5]) for k in range(len(words) - 4)], start + n
        near, a, b = min(n, P.AROUND), start, end
        for side, last in ((left, False), (right, True)):
            held = [tuple(side[k : k + 5]) for k in range(len(side) - 4)]
            place = before - start if not last else len(side) - after - end
            for i in (range(start, start + near - 4), range(end - 5, end - near - 1, -1))[last]:
                if shingle[i] in held:
                    j = min((k for k in range(len(held)) if held[k] == shingle[i]), key=lambda k: (abs(k - place - i), k))
                    if last:
                        while i < len(words) and j < len(side) and words[i] == side[j]:
                            i, j = i + 1, j + 1
                        b = max(b, i)
                    else:
                        while i > 0 and j > 0 and words[i - 1] == side[j - 1]:
                            i, j = i - 1, j - 1
                        a = min(a, i)
                    break
        return a, b

    texts, units, sides, want = [], [], [], []
    for d in range(30):
        keeper = rng.integers(0, 3 if d % 5 == 0 else 1 << 40, 220)
        text = np.concatenate([rng.integers(0, 1 << 40, 30), keeper[40:180], rng.integers(0, 1 << 40, 30)])
        text[rng.integers(0, len(text), 12)] = 7
        texts.append(text)
        for _ in range(6):
            n, at = int(rng.integers(5, 100)), int(rng.integers(0, 90))
            start = max(0, min(len(text) - n, at + int(rng.integers(-14, 2))))
            near, lo, hi = min(n, P.AROUND), max(0, at - P.AROUND), min(len(keeper), at + n + P.AROUND)
            left, right = keeper[lo : at + near], keeper[at + n - near : hi]
            units.append((d, start, n, at - lo, hi - at - n))
            sides.append((left, right))
            want.append(plain(text, start, n, left, right, at - lo, hi - at - n))
    row, start, n, before, after = (np.array(c) for c in zip(*units))
    at = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    t = P.Texts(0, at, np.concatenate(texts).astype(np.uint64), at[:0], at[:0])
    left, right = ((np.concatenate(c).astype(np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in c])])) for c in zip(*sides))
    a, b = P._extended(t, t.shingles(), row, start + at[row], n, left, right, before, after)
    assert list(zip(a.tolist(), b.tolist())) == want and sum(x < s for (x, _), s in zip(want, start)) > 30


def test_large_buckets_are_contracted_and_lose_no_link(spark, monkeypatch):
    rng = random.Random(15)
    docs = []
    for p in range(4):
        base = prose(rng, 60)
        for i in range(25):
            w = list(base)
            for _ in range(i % 4):
                w[rng.randrange(60)] = prose(rng, 1)[0]
            docs.append((len(docs), " ".join(w + prose(rng, 9))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, P.repeats(df, shortest=P.SHINGLE).collect()))
    monkeypatch.setattr(P, "ALL_PAIRS", 3)
    assert len(want) > 100 and sorted(map(tuple, P.repeats(df, shortest=P.SHINGLE).collect())) == want


def test_counts_come_back_in_the_order_of_the_block(spark):
    from streamlens.llm import common as C
    rng = np.random.default_rng(16)
    sets = [(b, d, rng.choice(400, 30, replace=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), b == 3) for b in range(6) for d in rng.integers(0, 1 << 40 if b % 2 else 9, 7)]
    blocks = []
    for b in range(6):
        own = [s for s in sets if s[0] == b]
        columns = (np.concatenate([x for _, _, x, _ in own]), np.full(len(own), 30), np.array([d for _, d, _, _ in own]), np.array([s for *_, s in own], np.uint8))
        blocks.append((b, *(bytearray(c.tobytes()) for c in columns), b * 10))
    blocks.append((9, *[bytearray()] * 4, 90))
    df = spark.createDataFrame(blocks, "block long, hashes binary, n binary, of binary, special binary, extra long")
    got = {r.extra: (r.hashes, r.df) for r in C.block_counts(df).collect()}
    times, owners, special = {}, {}, set()
    for _, d, x, s in sets:
        for h in x.tolist():
            times[h] = times.get(h, 0) + 1
            owners.setdefault(h, set()).add(int(d))
            special |= {h} if s else set()
    for b, hashes, *_, extra in blocks[:6]:
        want = [times[h] if times[h] > 1 and (len(owners[h]) > 1 or h in special) else 0 for h in np.frombuffer(hashes, np.uint64).tolist()]
        assert bytes(got[extra][0]) == hashes and np.frombuffer(got[extra][1], np.uint16).tolist() == want


def test_prefixes_of_many_sets_and_common_elements():
    import pyarrow as pa
    from streamlens.llm import common as C
    from streamlens.llm import jaccard_join as J
    rng = np.random.default_rng(17)
    n = rng.integers(1, 90, 200)
    m = np.minimum(n, rng.integers(0, 90, 200))
    df = [np.sort(rng.integers(2, 50, k)) for k in m]
    ell, size = J.choose_prefixes(np.concatenate(df), m, n, 75)
    assert list(zip(ell.tolist(), size.tolist())) == [J.choose_prefix(d, int(k), 75) for d, k in zip(df, n)]
    sets = [np.unique(rng.integers(0, 120, k).astype(np.uint64)) for k in [0, 1, 5, 40, 63, 64, 65, 100, 300] * 20]
    other = [sets[k] for k in rng.permutation(len(sets))]
    both = C.common_elements(*(pa.array([x.tobytes() for x in c], pa.binary()) for c in (sets, other)))
    assert both.tolist() == [len(np.intersect1d(a, b)) for a, b in zip(sets, other)]
