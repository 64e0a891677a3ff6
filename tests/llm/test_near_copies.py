"""The n-gram join and the component steps against brute force."""

import random
import re

import numpy as np
import pytest

from streamlens.llm import common, jaccard_join, kernels

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = [rng.choice(vocabulary) for _ in range(14)]  # a line that a third of all share
    out, base = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            words = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 20, 60, 120]))]
            if rng.random() < 0.4:
                words += line
            if len(base) < 12:
                base.append(words)
        out.append((i * 3 - 90, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.ngram_components(df).collect()}
    assert got == brute(rows)


def test_a_group_of_near_copies_around_a_centre(spark):
    """Copies link to the centre, seldom with each other; rounds of contraction must not lose any."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(70)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(70)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.ngram_components(df).collect()}
    assert got == brute(rows)


def test_links_are_whole_when_rounds_stop_early_or_late(spark):
    rng = np.random.default_rng(3)
    sets = {i: np.unique(rng.integers(0, 60, 12).astype(np.uint64)) for i in range(120)}
    members = [(int(t), i, len(s), len(s), 1, 0) for i, s in sets.items() for t in s]
    arrays = spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in sets.items()], "node long, n long, items binary")
    df = spark.createDataFrame(members, "bucket long, node long, n long, m long, ell int, pos long")
    want = {}
    parent = list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = set()
    for a in range(120):
        for b in range(a + 1, 120):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 40 * (len(sets[a]) + len(sets[b]) - both):
                linked |= {a, b}
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in linked}
    for few in (0, 10**9):
        got = {r.node: r.component for r in common.link_components(df, arrays, 40, "t", few=few).collect()}
        assert {k: v for k, v in got.items() if k in want} == want
        assert all(k == v for k, v in got.items() if k not in want)


def test_prefix_always_meets_a_linked_set():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        df = np.sort(rng.integers(2, 50, int(rng.integers(0, n + 1))))
        ell, size = jaccard_join.choose_prefix(df, n, 75)
        least = -(-75 * n // 100)
        assert 1 <= ell <= max(1, least)
        assert size == min(len(df), max(0, n - least + ell - (n - len(df))))


def test_longer_prefixes_are_chosen_where_candidates_are_dear():
    cheap = jaccard_join.choose_prefix(np.array([2] * 10), 10, 75)[0]
    dear = jaccard_join.choose_prefix(np.array([500] * 2000), 2000, 75)[0]
    assert cheap <= dear and dear > 1


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, i) for i in range(1001, 1100)]
    df = spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")
    got = {r.node: r.component for r in common.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1100)}}
    assert common.components(df.limit(0)).collect() == []


def test_edge_rows(spark):
    long_text = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None, "x", 1), (2, "", "x", 2), (3, " \t\n", None, 3), (4, "one two", "x", 4), (5, "ONE  two", "x", 5), (6, long_text, "x", 6),
            (7, long_text, "x", 7), (None, "one two", "x", 8), (7, long_text, "x", 9), (8, "é ß " * 9, "x", 1), (9, "only", "x", 1), (9, "an other text", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.ngram_components(df).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == (1, 4) and got[5] == (1, 4) and got[6] == got[7] == (29_996, 6)
    assert got[9] == (1, 9) and None not in got and len(got) == 9
    kept = jaccard_join.keep_one(df, jaccard_join.ngram_components(df))
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [(False, i) for i in (1, 2, 3, 4, 6, 8, 9, 9)]
    assert jaccard_join.ngram_components(df.limit(0)).collect() == []


def test_words_are_hashed_alike_in_slices_and_whole():
    text = ("Abc  déf\tg\n" * 5000 + "x" * 9000 + " end").encode()
    data = np.frombuffer(text, np.uint8)
    whole = kernels._segment(data, np.array([0]), True, kernels._WHITE)
    size = kernels.SLICE_BYTES
    try:
        kernels.SLICE_BYTES = 1000
        cut = kernels.hash_words(data, np.array([0]), True)
    finally:
        kernels.SLICE_BYTES = size
    assert all((a == b).all() for a, b in zip(whole, cut))
    assert [text[a:b] for a, b in zip(whole[0], whole[1])] == text.split()
