"""Quality by hierarchical empirical Bayes: a document's own evidence with the posteriors of its host and path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm import kernels as K
from streamlens.llm.common import stored, text_bytes
from streamlens.llm.fit import fit_logistic, margin
from streamlens.llm.host_rules import repeat_words

#: Labelled documents that the evidence model is fitted on at most.
SAMPLE = 20_000

FEATURES = ("log_words", "repeat_share", "dup_line_share", "symbol_share", "upper_share", "mark_share", "digit_share", "mean_word", "bar_share", "distinct_share")

_CLASS = {
    "symbol_share": b"#*$%&<>", "upper_share": bytes(range(65, 91)), "mark_share": b"!?", "digit_share": b"0123456789", "bar_share": b"|",
}


def features_of(column) -> np.ndarray:
    """Rows of FEATURES for an Arrow column of text bytes; a text without words is all 0."""
    out = np.zeros((len(column), len(FEATURES)))
    tables = {}
    for name, chars in _CLASS.items():
        tables[name] = np.zeros(256, bool)
        tables[name][list(chars)] = True
    for words in K.batch_words(column):
        rows = slice(words.first, words.last)
        n = np.diff(words.at).astype(float)
        lens = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
        chars = np.diff(lens[words.at])
        some = np.maximum(1, chars)
        block = out[rows]
        block[:, 0] = np.log1p(n)
        for name, table in tables.items():
            upto = np.concatenate([[0], np.cumsum(table[words.data])])
            block[:, FEATURES.index(name)] = np.diff(upto[words.row_at]) / some
        block[:, FEATURES.index("mean_word")] = np.log1p(chars / np.maximum(1, n))
        raw = words.data.tobytes()
        for r in np.flatnonzero(n):
            lines = [x for x in raw[words.row_at[r] : words.row_at[r + 1]].split(b"\n") if x.strip()]
            h = words.hashes[words.at[r] : words.at[r + 1]]
            block[r, 1] = repeat_words(h) / n[r]
            block[r, 2] = 1 - len(set(lines)) / len(lines)
            block[r, 9] = len(np.unique(h)) / n[r]
        block[n == 0] = 0
    return out


def _sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, where=None) -> DataFrame:
    """text and label of at most ``bound`` labelled documents, those of least hash: the same whatever the partitions."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(bound)  # 12 bytes a row: small whatever the corpus holds
    return docs.join(F.broadcast(known), F.col("doc_id").cast("long") == F.col("__id")).select(text_bytes().alias("text"), "y", F.col("__id"))


def fit_evidence(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE):
    """The evidence model and the share of good documents it was fitted on; None for the model without both labels."""
    def make(batches):
        for batch in batches:
            x = features_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(x[:, i]) for i in range(len(FEATURES)))], ["y", "id", *FEATURES])

    rows = _sample(docs, labels, "quality", bound).mapInArrow(make, "y int, id long, " + ", ".join(f"{c} double" for c in FEATURES)).toPandas()
    if rows["y"].nunique() < 2:
        return None, 0.5
    rows = rows.sort_values(["id", *FEATURES])
    y = rows["y"].to_numpy(float)
    return fit_logistic(rows[list(FEATURES)].to_numpy(), y, np.ones(len(y))), float(np.clip(y.mean(), 0.01, 0.99))


def _strength(rows: DataFrame, mean: str) -> F.Column:
    """Prior strength from units (n, s = sum of probabilities) around ``mean``, as one aggregate expression."""
    n, rate = F.col("n"), F.col("s") / F.col("n")
    v = F.sum(n * F.pow(rate - F.col(mean), 2)) / F.sum(n) - F.sum(F.col(mean) * (1 - F.col(mean))) / F.sum(n)
    spread = F.sum(n * F.col(mean) * (1 - F.col(mean))) / F.sum(n)
    return F.when(v > 0, F.least(F.lit(10000.0), F.greatest(F.lit(1.0), spread / v - 1))).otherwise(F.lit(10000.0))


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", bound: int = SAMPLE) -> DataFrame:
    """doc_id, host, path, evidence (log odds of good over bad from the text), host_rate, path_rate, score, kept.

    The evidence model is a logistic regression on features of the text, fitted on at most ``bound`` labelled documents;
    everything else is over all rows. Hosts and, inside them, paths have the mean probability of their documents, shrunk
    towards the host's or the corpus' rate with a strength taken from how much hosts (paths) really differ; so a sparse site
    hardly moves from its parent. A document's own probability is left out of its path's rate. Posterior log odds are the
    evidence plus those of the path's rate; kept: score at least 0.5.

    Null hosts and paths count as empty names. Null and empty texts have no words; their features are 0. Repeated rows count
    and are scored each; a null doc_id stays null. Without labels of both kinds the evidence is 0 and every document is kept.
    """
    model, base = fit_evidence(docs, labels, bound)

    def weigh(batches):
        for batch in batches:
            m = np.zeros(batch.num_rows) if model is None else margin(features_of(batch.column(3)), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(m)], ["doc_id", "host", "path", "m"])

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), name(host).alias("host"), name(path).alias("path"), text_bytes().alias("text"))
    rows = stored(rows.mapInArrow(weigh, "doc_id long, host string, path string, m double").withColumn("p", 1 / (1 + F.exp(-F.col("m")))), "evidence")
    paths = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    overall = hosts.agg((F.sum("s") / F.sum("n")).alias("g"))
    hosts = hosts.crossJoin(F.broadcast(overall))
    k = hosts.agg(_strength(hosts, "g").alias("k"))
    hosts = hosts.crossJoin(F.broadcast(k)).select("host", ((F.col("s") + F.col("k") * F.col("g")) / (F.col("n") + F.col("k"))).alias("host_rate"))
    inside = paths.join(hosts, "host")
    j = inside.agg(_strength(inside, "host_rate").alias("j"))
    inside = inside.crossJoin(F.broadcast(j))
    out = rows.join(inside, ["host", "path"])
    rate = (F.col("s") - F.col("p") + F.col("j") * F.col("host_rate")) / (F.col("n") - 1 + F.col("j"))
    rate = F.least(F.lit(0.999999), F.greatest(F.lit(0.000001), rate))
    evidence = F.col("m") - F.lit(float(np.log(base / (1 - base)))) if model is not None else F.lit(0.0)
    odds = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) + F.col("evidence")
    out = out.withColumns({"path_rate": rate, "evidence": evidence})
    return out.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-odds))).alias("score"),
                      (odds >= 0).alias("kept") if model is not None else F.lit(True).alias("kept"))
