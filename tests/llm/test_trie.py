"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from streamlens.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, block=100, heads=6):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = own.get(c - c % block, [])[:h] + v[h:]
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    return {(m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k],
             hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(k)).encode()).hexdigest()) for k, m in members.items()}


def rows_of(seed, n=60):
    rng = random.Random(seed)
    words = ["", "hé", "yes", "no way", "日本"]
    out = []
    for c in rng.sample(range(0, 450), n):
        out += [(c, t, rng.choice(["user", "bot"]), rng.choice(words)) for t in range(rng.randrange(0, 9))]
    for c in range(200, 212):  # copies
        out += [(c, t, "user", "same") for t in range(7)]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rows = rows_of(seed)
    got = [tuple(r) for r in P.trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("roots", [P.ROOTS, 0])
def test_small_shards_spilling_queues_and_cut_conversations(spark, monkeypatch, chunks, roots):
    """Paths that change their shard every two levels, a queue of three messages, conversations cut into chunks of five."""
    monkeypatch.setattr(P, "FAMILY", 1)
    monkeypatch.setattr(P, "DEEP", 2)
    chunks(5)
    rows = rows_of(7, 30) + [(301, t, "user", "deep") for t in range(40)] + [(302, t, "user", "deep") for t in range(35)]
    got = [tuple(r) for r in P.trie(spark.createDataFrame(rows, SCHEMA), limit=3, roots=roots).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_odd_rows(spark):
    """Null turns come first, ties by role and text; repeated rows stay two turns; a null id is in no conversation."""
    rows = [(100, None, "user", "first"), (100, 1, None, None), (100, 1, None, None), (100, 2, "user", "x" * 200_000), (101, 5, "a", "t"), (101, 5, "a", "t"), (101, 3, "a", None),
            (None, 1, "user", "lost"), (7, 1, "u", "alone"), (10**17 + 3, 1, "u", "far")]
    d = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({}).withColumn("depth", P.F.lit("clash")).withColumn("id", P.F.lit(1))
    assert {tuple(r) for r in P.trie(d).collect()} == brute(rows)
    assert P.trie(d.limit(0)).collect() == []
    one = [(7, 1, "u", "x")]
    assert {tuple(r) for r in P.trie(spark.createDataFrame(one, SCHEMA)).collect()} == brute(one)


def test_queue_spills_and_keeps_its_order():
    rng = random.Random(1)
    items = [(rng.randrange(20), f"n{rng.randrange(9)}", rng.randrange(5), 1, []) for _ in range(500)]
    q = P.SpillingQueue(limit=16)
    for x in items:
        q.push(*x)
    assert q.spilled > 10
    for key in sorted({(-x[0], x[1]) for x in items}):
        got = sorted(a for a, _, _ in q.pop_for(-key[0], key[1]))
        assert got == sorted(x[2] for x in items if (-x[0], x[1]) == key)
    assert not q.heap and not q.runs
