"""URL filter: rules on host and path, else naive Bayes over words that a unigram Viterbi finds in host names."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Longest dictionary word that a host name is searched for.
MAX_WORD = 20

#: Seed words: a host that is segmented into one of them is an example of what to block.
SEEDS = (
    "ad", "ads", "adserver", "banner", "bet", "betting", "casino", "cheap", "click", "clicks", "coupon", "dating", "escort", "gamble",
    "loan", "loans", "pharmacy", "pill", "pills", "poker", "popup", "porn", "promo", "sex", "slots", "spam", "sponsor", "track",
    "tracker", "tracking", "viagra", "warez", "xxx")


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url) -> tuple[F.Column, F.Column]:
    """host (A-Z lower-cased) and path of a URL column; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring({0}, {1} + 3)".format("`__url`", "instr(`__url`, '://')"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rules(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """urls plus host, path, rule and rule_verdict: those of the longest rule that fits, else null. A rule fits its host and
    subdomains if the path starts with the rule's. Rules are a short stated list and become one expression."""
    urls = urls.drop("host", "path", "rule", "rule_verdict").withColumn("__url", F.col("url").cast("string"))
    host, path = url_parts(F.col("__url"))
    urls = urls.withColumns({"host": host, "path": path}).drop("__url")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # later, that is longer, rules are asked first
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        name, verdict = F.when(fits, r.text).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return urls.withColumns({"rule": name, "rule_verdict": verdict})


# -- words in host names -------------------------------------------------------------------------------
def _pieces(host):
    """Runs of letters of a host name."""
    return F.array_distinct(F.filter(F.split(host, r"[^\p{L}]+"), lambda x: x != ""))


def unigrams(texts: DataFrame, hosts: DataFrame) -> DataFrame:
    """(word, n): how often each word of 2 to MAX_WORD letters comes up in the texts (tags apart) and between the hyphens of a
    host; counted over all rows, pre-aggregated before the shuffle."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), r"<[^>]*>", " "))
    words = texts.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word")).where(F.length("word").between(2, MAX_WORD))
    labels = hosts.select(F.explode(F.split("host", r"[.:]")).alias("label")).where(F.contains("label", F.lit("-")))
    cut = labels.select(F.explode(_pieces(F.col("label"))).alias("word")).where(F.length("word").between(2, MAX_WORD))
    return words.union(cut).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(piece: str, count: dict[str, int], total: int) -> list[str]:
    """The most probable split of a piece: a word costs -log(n / total), letters in no word are kept together as an unknown
    word at a cost of log(total) and 2.3 for each letter. Equal costs prefer fewer, then longer first words."""
    n = len(piece)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(math.inf, 0, 0)] * n
    for end in range(1, n + 1):
        for start in range(end):
            word = piece[start:end]
            k = count.get(word)
            cost = -math.log(k / total) if k else math.log(total) + 2.3 * (end - start)
            found = (best[start][0] + cost, best[start][1] + 1, start)
            if found[:2] < best[end][:2] or found[:2] == best[end][:2] and start > best[end][2]:
                best[end] = found
    out, end = [], n
    while end:
        start = best[end][2]
        out.append(piece[start:end])
        end = start
    return out[::-1]


def _segment(piece: pd.Series, words: pd.Series, counts: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series([viterbi(p, dict(zip(w, c)), int(t)) for p, w, c, t in zip(piece, words, counts, total)])


def segmented(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words): the words of every distinct host, each piece split by Viterbi over the unigram counts ``words``.

    Only those dictionary words that are part of a piece meet it: substrings are joined with the dictionary, so neither the
    dictionary nor the hosts are sent whole to any task."""
    pieces = hosts.select("host", F.explode(_pieces(F.col("host"))).alias("piece"))
    distinct = pieces.select("piece").distinct()
    parts = distinct.select("piece", F.explode(F.expr(
        f"flatten(transform(sequence(1, length(piece)), i -> transform(sequence(1, least({MAX_WORD}, length(piece) - i + 1)), l -> substring(piece, i, l))))")).alias("word")).distinct()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total"))
    known = parts.join(words, "word").groupBy("piece").agg(F.collect_list("word").alias("ws"), F.collect_list("n").alias("cs"))
    none = F.array().cast("array<string>"), F.array().cast("array<long>")
    segment = F.pandas_udf(_segment, "array<string>")
    split = distinct.join(known, "piece", "left").crossJoin(F.broadcast(total)).select(
        "piece", segment("piece", F.coalesce("ws", none[0]), F.coalesce("cs", none[1]), "total").alias("split"))
    return pieces.join(split, "piece").groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("split"))).alias("words"))


# -- naive Bayes -------------------------------------------------------------------------------------------
def bayes_scores(urls: DataFrame, words: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """(host, path, log_odds) of every distinct host and path: multinomial naive Bayes over the host's words and the path's
    (runs of letters; digits do not count), block against allow.

    Examples are the URLs themselves: those whose host holds a seed word are block, all others allow; counts are over all
    rows, with add-one smoothing, so words that keep company with seeds weigh too."""
    sites = urls.groupBy("host", "path").agg(F.count("*").alias("m"))
    named = sites.join(words, "host", "left")
    none = F.array().cast("array<string>")
    host_words = F.transform(F.coalesce("words", none), lambda w: F.concat(F.lit("h:"), w))
    path_words = F.transform(F.filter(F.split(F.lower("path"), r"[^\p{L}]+"), lambda x: x != ""), lambda w: F.concat(F.lit("p:"), w))
    seed = F.arrays_overlap(F.coalesce("words", none), F.array(*map(F.lit, seeds)))
    rows = stored(named.select("host", "path", "m", F.concat(host_words, path_words).alias("tokens"), F.coalesce(seed, F.lit(False)).alias("block")), "sites")
    counts = rows.select("m", "block", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.sum(F.when(F.col("block"), F.col("m")).otherwise(0)).alias("b"), F.sum(F.when(~F.col("block"), F.col("m")).otherwise(0)).alias("a"))
    sums = counts.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("tb"), F.coalesce(F.sum("a"), F.lit(0)).alias("ta"), F.count("*").alias("v"))
    # stored, so that Spark knows its size: a small model is broadcast, and tokens that most hosts have are not gathered in a task
    model = stored(counts.crossJoin(F.broadcast(sums)).select(
        "token", (F.log((F.col("b") + 1) / (F.col("tb") + F.col("v"))) - F.log((F.col("a") + 1) / (F.col("ta") + F.col("v")))).alias("w")), "token-weights")
    prior = rows.agg(F.log((F.coalesce(F.sum(F.when(F.col("block"), F.col("m"))), F.lit(0)) + 1) / (F.coalesce(F.sum(F.when(~F.col("block"), F.col("m"))), F.lit(0)) + 1)).alias("prior"))
    scored = rows.select("host", "path", F.explode("tokens").alias("token")).join(model, "token").groupBy("host", "path").agg(F.sum("w").alias("w"))
    return rows.select("host", "path").join(scored, ["host", "path"], "left").crossJoin(F.broadcast(prior)).select(
        "host", "path", (F.coalesce("w", F.lit(0.0)) + F.col("prior")).alias("log_odds"))


def judge(pages: DataFrame, rules: Sequence[Rule], seeds: Sequence[str] = SEEDS) -> DataFrame:
    """page_id, host, path, rule, log_odds and verdict (allow or block) of every row of pages (page_id, url, html).

    The longest fitting rule decides; without one, block if naive Bayes finds it likelier than allow. Nulls and URLs without
    ``://`` have an empty host and path and are judged by the prior. Rows are never merged: repeated ones are each judged.
    Other columns are ignored; an empty table gives no rows. A host with many pages is one row until the last join, which
    Spark can split.
    """
    urls = with_rules(pages.select("page_id", "url"), rules).drop("url")
    hosts = urls.select("host").distinct()
    words = stored(segmented(hosts, unigrams(pages, hosts)), "host-words")
    scores = bayes_scores(urls, words, seeds)
    out = urls.join(scores, ["host", "path"])
    return out.select("page_id", "host", "path", "rule", "log_odds",
                      F.coalesce("rule_verdict", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"))
