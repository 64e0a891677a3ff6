"""Phrases against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from streamlens.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, top=2000, covered=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang or "und"][tuple(w[i : i + m])] += 1
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + m] for q, b in cand.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * b >= covered * count[q[i : i + m]]}
        rows_ = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["été", "The", "a b"]
    phrase = ["new", "york", "stock", "exchange", "today", "again"]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(1, 30)):
            w += phrase[rng.randrange(3) : rng.randrange(2, 7)] if rng.random() < 0.2 else [rng.choice(vocab)]
        out.append((rng.choice([" ", "  ", "\t"]).join(w).replace("w3", "w3" + rng.choice([".", ",", "\n", "!"])), rng.choice(["en", "de", None])))
    return out


@pytest.mark.parametrize("seed,budget", [(0, 250_000), (1, 4), (2, 60)])
def test_equals_brute_force(spark, seed, budget):
    """A budget of a few leaves makes prefixes of three words and hundreds of groups."""
    rows = texts(seed)
    d = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in C.mine(d, least=4, budget=budget).collect())
    assert got == brute(rows, 4) and len(got) > 50
    assert sorted(tuple(r) for r in C.mine(d, least=4, budget=budget, top=3, covered=80).collect()) == brute(rows, 4, 3, 80)


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, overlaps, columns with clashing names."""
    rows = [(None, "en"), ("", None), ("a a a a a a", None), ("a a a a a a", None), ("x y " * 50_000, "en"), ("Z" * 100_000 + " y", "en"), (",;.", "en")]
    d = spark.createDataFrame([(None, t, x) for t, x in rows], SCHEMA).selectExpr("doc_id", "text", "lang", "'k' as key", "1 as words", "2 as __col0")
    assert sorted(tuple(r) for r in C.mine(d, least=2).collect()) == brute(rows, 2)
    assert C.mine(d.limit(0)).collect() == [] and C.mine(d, least=10**9).collect() == []


def test_tasks_hand_on_what_they_hold(spark, monkeypatch):
    rows = texts(5, 60)
    d = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], SCHEMA)
    tally = C._Tally()
    rng = np.random.default_rng(0)
    monkeypatch.setattr(C, "HELD", 50)
    want, got = Counter(), Counter()
    for _ in range(20):
        keys = rng.integers(0, 90, 40).astype(np.uint64)
        want.update(keys.tolist())
        tally.add(keys, keys * np.uint64(2))
        if tally.full():
            k, n, twice = tally.take()
            assert (twice == 2 * k).all()
            got.update(dict(zip(k.tolist(), n.tolist())))
    k, n, _ = tally.take() or ([], [], None)
    got.update(dict(zip(np.asarray(k).tolist(), np.asarray(n).tolist())))
    assert got == want
    assert sorted(tuple(r) for r in C.mine(d, least=3).collect()) == brute(rows, 3)


def test_filter_turns_no_member_away(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    f = C.make_filter(spark.createDataFrame([(int(k),) for k in keys], "key long"), "key")
    assert f.has(keys.view(np.uint64)).all()
    assert f.has(rng.integers(0, 1 << 63, 100_000).astype(np.uint64)).mean() < 0.05
