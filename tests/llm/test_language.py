"""Language ID: words, Viterbi and predictions against plain versions."""

import itertools
import re

import numpy as np
import pytest

from streamlens.llm import language_id as L
from streamlens.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string"


def test_words_of_letters_and_marks():
    texts = ["", "Ab1 cé́x-ß", "αβγabc", "日本 語x", "123 !?", "́a", "ab" * 3000]
    w = L.text_words(texts)
    got = [[texts[r][w.start[i] : w.end[i]] for i in range(w.at[r], w.at[r + 1])] for r in range(len(texts))]
    assert got == [[], ["Ab", "cé́x", "ß"], ["αβγ", "abc"], ["日", "本", "語", "x"], [], ["a"], ["ab" * 3000]]
    assert w.letters.tolist() == [sum(c.isalpha() for c in x) for row in got for x in row]
    assert len(w.grams) == w.gram_at[-1] and (np.diff(w.gram_at) == [len(x) + 2 for row in got for x in row]).all()


def test_equal_words_have_equal_grams_wherever_they_stand():
    w = L.text_words(["the cat", "a THE", "the"])
    grams = [w.grams[w.gram_at[i] : w.gram_at[i + 1]].tolist() for i in (0, 3, 4)]
    assert grams[0] == grams[1] == grams[2]


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_is_the_best_of_all_labellings(seed):
    rng = np.random.default_rng(seed)
    lens = rng.integers(0, 7, 9)
    at = np.concatenate([[0], np.cumsum(lens)])
    scores = rng.normal(0, 2, (at[-1], 3)).round(1)
    got = L.viterbi(scores, at, 1.5)
    value = lambda s, x: sum(s[i, k] for i, k in enumerate(x)) - 1.5 * sum(a != b for a, b in zip(x, x[1:]))
    for lo, hi in zip(at[:-1], at[1:]):
        s = scores[lo:hi]
        best = max((value(s, x) for x in itertools.product(range(3), repeat=hi - lo)), default=0)
        assert value(s, got[lo:hi]) == pytest.approx(best)


def test_spans_of_mixed_text_and_scripts(spark):
    words = {"en": "the house and water with they there which would", "de": "der und nicht straße über zwischen wäre haus", "el": "και το σπίτι είναι νερό", "ru": "и дом вода который было"}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words[x].split(), 30)), x, "s") for i, x in enumerate(["en", "de", "el", "ru"] * 30)]
    model = L.fit(spark.createDataFrame(rows, SCHEMA))
    assert set(model.langs) == set(words)
    mixed = "the house and water with they there und der straße über nicht zwischen haus και το σπίτι"
    (got,) = L.label(spark.createDataFrame([(1, mixed, None, None)], SCHEMA), model).collect()
    assert [s.lang for s in got.spans] == ["en", "de", "el"] and got.lang_pred == "de"
    assert [mixed[s.start : s.end] for s in got.spans] == ["the house and water with they there", "und der straße über nicht zwischen haus", "και το σπίτι"]
    assert sum(s.letters for s in got.spans) == len(re.findall(r"[^\W\d_]", mixed))
    assert 0.3 < got.score < 0.6  # the share of the letters in German spans


def test_odd_rows(spark):
    long = "das ist ein langer text und " * 30_000
    rows = [(5, "the and of", "en", "a"), (5, "the and of", "en", "a"), (6, None, "en", "a"), (7, "", "en", "a"), (8, "12 ?!", None, "a"), (None, "and the", "en", "a"),
            (9, long, "de", "a"), (11, "das ist", "de", "a"), (12, "日本語", None, None)]
    d = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "score")  # a clashing name is not read
    got = sorted((r.doc_id is None, r.doc_id or 0, r.lang_pred, r.score) for r in L.identify(d).collect())
    assert [(x[1], x[2]) for x in got] == [(5, "en"), (5, "en"), (6, "und"), (7, "und"), (8, "und"), (9, "de"), (11, "de"), (12, got[7][2]), (0, "en")]
    assert got[7][2] in ("en", "de") and all(0 <= x[3] <= 1 for x in got) and [x[3] for x in got if x[2] == "und"] == [0, 0, 0]
    none = L.identify(d.withColumn("lang", L.F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert L.identify(d.limit(0)).collect() == []


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op11_language_id"](spark, path).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert len(held) > 100 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.99


def test_labels_of_held_out_rows_are_not_read(spark):
    path = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{path}/documents.parquet")
    other = d.withColumn("lang", L.F.when(L.held_out("doc_id"), L.F.lit("xx")).otherwise(L.F.col("lang"))).withColumn("source", L.F.lit("s"))
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in L.identify(df).collect())
    assert key(d) == key(other)
