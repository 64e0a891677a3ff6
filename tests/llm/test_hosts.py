"""Host rules, URL filter and quality: shrinkage, segmentation, edge rows."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from streamlens.llm import host_rules, quality_bayes, url_filter
from streamlens.llm.queries import RULES

GOOD = "the quick brown fox jumps over the lazy dog while many other animals look on from afar"
JUNK = "buy*** now### cheap$$$ best%%% deal&&& ever*** click### here$$$ today%%% only&&& friends***"


# -- host rules -------------------------------------------------------------------------------------------
def test_a_bad_host_takes_its_documents_along_and_a_small_one_does_not(spark):
    rows = [(i, "bad", GOOD if i % 10 == 0 else JUNK) for i in range(200)]
    rows += [(1000 + i, f"fine{i % 5}", GOOD if i % 20 else JUNK) for i in range(600)]
    rows += [(5000, "tiny", JUNK), (5001, "tiny", GOOD)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = {r.doc_id: r for r in host_rules.judge(df).collect()}
    assert not out[0].base_failed and out[0].host_rejected and not out[0].kept
    assert all(out[1000 + i].kept for i in range(600)) and out[5001].kept and out[5000].kept
    hosts = host_rules.host_verdicts(df.select("source", (F.col("text") == JUNK).alias("failed")), "source", 0.5)
    rate = {r.host_key: r.rate for r in hosts.collect()}
    overall = (180 + 30 + 1) / 802
    assert overall < rate["tiny"] < 0.5 and abs(rate["bad"] - 0.9) < 0.05


def test_rule_counts_by_hand(spark):
    text = "a b c d e a b c d e x\n\n# * $\n# * $\n  \nä"
    df = spark.createDataFrame([(1, text, 5), (2, None, 6), (3, "", 7), (4, "w " * 2_000_000, 8)], "doc_id long, text string, n_words int")
    out = {r.doc_id: r for r in host_rules.judge(df.withColumn("source", F.lit(None).cast("string"))).collect()}
    r = out[1]
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == (18, 18, 6, 4, 1, 10)
    assert out[2].n_words == out[3].n_words == 0 and out[2].base_failed and not out[2].kept
    assert out[4].n_repeat_words == 2_000_000 and out[4].base_failed
    assert host_rules.judge(df.withColumn("source", F.lit("x")).limit(0)).collect() == []


def test_keep_good_keeps_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, GOOD, "s", True), (1, GOOD, "s", True), (None, GOOD, None, None), (2, "few", "s", False)], "doc_id long, text string, source string, kept boolean")
    out = host_rules.keep_good(df)
    assert out.columns == df.columns and sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, ((1, GOOD, "s", True), (1, GOOD, "s", True), (None, GOOD, None, None))))


# -- URL filter ----------------------------------------------------------------------------------------------
def brute_split(piece, count, total):
    best = None
    for mask in range(1 << (len(piece) - 1)):
        words, last = [], 0
        for i in range(1, len(piece)):
            if mask >> (i - 1) & 1:
                words.append(piece[last:i])
                last = i
        words.append(piece[last:])
        cost = sum(-math.log(count[w] / total) if w in count else math.log(total) + 2.3 * len(w) for w in words)
        if best is None or cost < best - 1e-9:
            best = cost
    return best


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_is_optimal(seed):
    rng = random.Random(seed)
    count = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 90) for _ in range(25)}
    total = sum(count.values())
    for _ in range(20):
        piece = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 11)))
        words = url_filter.viterbi(piece, count, total)
        assert "".join(words) == piece
        cost = sum(-math.log(count[w] / total) if w in count else math.log(total) + 2.3 * len(w) for w in words)
        assert abs(cost - brute_split(piece, count, total)) < 1e-6


def brute_rule(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def test_rules_on_all_pages_and_odd_urls(spark):
    urls = pq.read_table("/root/testdata/sf0.01/pages.parquet")["url"].to_pylist()
    urls += [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com", "http://example.com?x/en/", "x://a.net/es/#f", "x://anet/es/", "a://b://c.com/en/",
             "http://net/fr/", "http://xexample.com/en/", "http://É.net/fr/?", "http://a.com\n/x", "http://example.com/en", "http://m.www.example.com/en/a"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.rule_verdict) for r in url_filter.with_rules(df, RULES).collect()}
    assert got == {i: brute_rule(u) for i, u in enumerate(urls)}


def test_seeds_spread_through_concatenated_names(spark):
    html = "<p>" + "cheap pills garden house music river stone casino " * 20 + "</p>"
    rows = [(i, f"http://{h}.org/a/{i}", html, "x") for i, h in enumerate(["cheappills", "cheap-house", "gardenmusic", "riverstone", "bigcasino", "stonehouse"] * 4)]
    rows += [(900, None, None, None), (901, "", html, None), (901, "", html, None), (902, "http://" + "z" * 300 + ".org/", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    out = url_filter.judge(df, []).collect()
    assert len(out) == len(rows)
    verdict = {r.host.split(".")[0]: r.verdict for r in out if r.host}
    assert verdict["cheappills"] == verdict["bigcasino"] == "block" and verdict["gardenmusic"] == verdict["riverstone"] == verdict["stonehouse"] == "allow"
    assert url_filter.judge(df.limit(0), RULES).collect() == []
    words = url_filter.segmented(df.sparkSession.createDataFrame([("cheappills.org",)], "host string"), url_filter.unigrams(df, df.selectExpr("'org' host")))
    assert set(words.first().words) == {"cheap", "pills", "org"}


# -- quality ------------------------------------------------------------------------------------------------------
def test_quality_on_documents_not_used_for_the_fit(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    out = quality_bayes.score(docs, train).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "kept", "score").toPandas()
    good = out["quality"] == 1
    assert out["kept"][good].mean() > 0.99 and (~out["kept"][~good]).mean() > 0.8


def test_rates_are_shrunk_from_path_to_host_to_corpus(spark):
    rows = [(i, GOOD + f" {i}", "big", "a") for i in range(80)] + [(100 + i, JUNK, "poor", "a") for i in range(80)] + [(500, GOOD, "new", "b"), (501, JUNK, "poor", "z")]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = {r.doc_id: r for r in quality_bayes.score(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert out[0].host_rate > out[500].host_rate > out[100].host_rate
    assert out[501].path_rate < 0.5 and out[0].kept and out[500].kept and not out[100].kept


def test_quality_edge_rows(spark):
    df = spark.createDataFrame([(None, None, None, None, 0.5), (1, "", "s", "l", 0.5), (1, GOOD, "s", None, 0.1), (2, "x" * 3_000_000, "s", "l", 0.1)], "doc_id long, text string, source string, lang string, p double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_bayes.score(df, none).collect()
    assert len(out) == 4 and all(r.kept and r.evidence == 0 for r in out)
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 1, 0), (2, 0, None), (2, 7, 0)], "doc_id long, quality int, toxic int")
    assert len(quality_bayes.score(df, odd).collect()) == 4
    assert quality_bayes.score(df.limit(0), odd).collect() == []
    x = quality_bayes.features_of(__import__("pyarrow").array([None, b"", b"  ", b"A b"], "binary"))
    assert (x[:3] == 0).all() and np.isfinite(x).all()
