"""Decontamination against brute force, and offsets in the original."""

import random
import re

import pytest

from streamlens.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, width=10):
    out = {}
    for d, text in docs:
        ws, hit, found = words(text), set(), set()
        for i, item in items:
            iw = words(item)
            k = min(width, len(iw))
            grams = {tuple(iw[a : a + k]) for a in range(len(iw) - k + 1)} if k else set()
            for a in range(len(ws) - k + 1) if k else ():
                if tuple(ws[a : a + k]) in grams:
                    hit.update(range(a, a + k))
                    found.add(str(i))
        out[d] = (len(ws), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_equals_brute_force(spark, block):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(rng.choice([1, 4, 9, 10, 25])))) for i in range(12)]
    items += [(100, None), (101, " ,. "), (10, "Ünï, CODE!"), (11, items[3][1])]
    docs = []
    for d in range(60):
        parts = [rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(items)[1] or ""
            parts.insert(rng.randrange(len(parts) + 1), t.upper().replace(" ", rng.choice([", ", "\n", "--"])))
        docs.append((d, "; ".join(parts)))
    docs += [(1000, None), (1001, ""), (1002, "été ünï code x " * 3000)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_hit int, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(df, bench, block_bytes=block).collect()}
    assert got == brute(docs, items)


def test_offsets_point_into_the_original(spark):
    item = "one two three four five six seven eight nine ten eleven"
    text = "Ärger — ONE, two;  three\nfour (five) six “seven” eight-nine ten! Eleven? Übrig"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = decontaminate.contamination(df, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    # the curly quotes are bytes from 0x80, which belong to words: "“seven”" is another word
    assert r.n_hit == 0
    r = decontaminate.contamination(df.selectExpr("doc_id", "translate(text, '“”', '\"\"') text"), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    plain = text.replace("“", '"').replace("”", '"')
    (span,) = r.hits
    assert plain[span.start : span.end] == 'ONE, two;  three\nfour (five) six "seven" eight-nine ten! Eleven' and r.n_hit == 11


def test_clean_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c", 5), (2, "x", 6), (3, None, 7)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(1, "b")], "item_id long, text string")
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.select("doc_id", "n_words").collect()) == [(2, 6), (3, 7)]
    assert decontaminate.clean(df.limit(0), bench).collect() == []
    none = decontaminate.contamination(df, bench.limit(0))
    assert {(r.doc_id, r.n_words, r.n_hit) for r in none.collect()} == {(1, 3, 0), (2, 1, 0), (3, 0, 0)}
