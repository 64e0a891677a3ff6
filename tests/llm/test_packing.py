"""Packing: every id in exactly one piece, no padding."""

from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from streamlens.llm import packing
from streamlens.llm.tokens import WordIds, vocabulary_path


@pytest.mark.parametrize("seed", range(5))
def test_lengths(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 900, 200), rng.integers(1, 9000, 20), [2048, 4096, 1]])
    rows = packing.pack_lengths(lengths, 2048)
    seen, sequences = defaultdict(list), defaultdict(list)
    for d, start, n, s, offset in rows:
        seen[d].append((start, n))
        sequences[s].append((offset, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[d]):
            assert start == at and size > 0
            at += size
        assert at == n
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= 2048 and at & (at - 1) == 0  # a power of two: no padding
    assert sum(1 for p in sequences.values() if sum(n for _, n in p) < 2048) <= 11


def test_costs_are_balanced():
    """Sequences made of whole documents differ far less in cost than those of first come, first packed."""
    rng = np.random.default_rng(1)
    lengths = rng.integers(50, 1500, 600)
    per = defaultdict(float)
    for _, _, n, s, _ in packing.pack_lengths(lengths, 2048):
        per[s] += packing.cost(n)
    order, at = defaultdict(float), 0
    for n in lengths:
        while n:
            take = min(int(n), 2048 - at % 2048)
            order[at // 2048] += packing.cost(take)
            n, at = n - take, at + take
    spread = lambda x: np.std([v for v in x.values()][:-12])
    assert spread(per) < spread(order)


def test_tokens(spark):
    texts = [None, "", "Hello, World! It's 3.14 o'clock...", "naïve Ünïcode İstanbul ΑΣ Å ﬁ ᾀ é", "a<|endoftext|>b <|ENDOFTEXT|> <|x", "word. word, word., 's 'll don't.",
             "tab\tnew\nline nbsp em \x1c sep", "Thnd*** iner### x|y |", "漢字かな交じり文。終", "long " * 5000, "\u0000 nul", "!?!?!? a!b?c"]
    rows = [(i, t, "x", 0, 0) for i, t in enumerate(texts)] + [(None, "no id", "x", 0, 0), (3, texts[3], "x", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, length int, sequence_id int")
    got = packing.pack(df, window=3000).collect()
    t = Tokenizer.from_file(vocabulary_path())
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x, *_ in rows]
    by_doc = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for i in set(range(len(texts))) - {3}:
        pieces = sorted(by_doc[i])
        assert sum((p[1] for p in pieces), []) == want[i] and {p[2] for p in pieces} == {len(want[i])}
    assert sum(len(p[1]) for p in by_doc[3]) == 2 * len(want[3])
    assert packing.pack(df.limit(0)).collect() == []


def test_cached_words_equal_the_tokenizer():
    import pyarrow.parquet as pq

    texts = [t.encode() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:300]]
    coder = WordIds(vocabulary_path())
    ids, n = coder.encode(texts, 1)
    t = Tokenizer.from_file(vocabulary_path())
    at = np.concatenate([[0], np.cumsum(n)])
    for k, x in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*t.encode(x.decode(), add_special_tokens=False).ids, 1]
    assert (coder.counts(texts) + 1 == n).all()


def test_packing_keeps_its_words_and_no_others_automaton():
    from streamlens.llm import decontaminate, kernels, packing, tokens

    tokens.word_ids(tokens.vocabulary_path())
    decontaminate._automaton((("i", b"one two three"),), 2)
    kernels.release(caches=True, but=tokens._forget)
    assert decontaminate._automaton.cache_info().currsize == 0 and tokens.word_ids.cache_info().currsize == 1
    assert packing.PIECES * 2048 * 4 <= 2 << 20  # bytes of ids that a worker hands to the JVM at a time
