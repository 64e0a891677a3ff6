"""Quality rules whose verdict is taken per host: failures by domain, rates shrunk by an empirical beta prior."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm import kernels as K
from streamlens.llm.common import set_aside, stored, text_bytes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeat_words(hashes: np.ndarray, k: int = 5) -> int:
    """Words in ``k``-word windows that occur twice or more."""
    n = len(hashes)
    if n <= k:
        return 0
    _, back, count = np.unique(K.shingle_hashes(hashes, k), return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    if not len(at):
        return 0
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def _stats(batches):
    K.release(caches=True)
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        n = batch.num_rows
        out = {c: np.zeros(n, np.int64) for c in STATS}
        for words in K.batch_words(text):
            rows = slice(words.first, words.last)
            out["n_words"][rows] = np.diff(words.at)
            head = ~_BLANK[words.data] & ((words.data & 0xC0) != 0x80)
            for name, mask in (("word_chars", head), ("n_symbols", _SYMBOL[words.data])):
                upto = np.concatenate([[0], np.cumsum(mask)])
                out[name][rows] = np.diff(upto[words.row_at])
            raw = words.data.tobytes()
            for r in range(words.last - words.first):
                lines = [x for x in raw[words.row_at[r] : words.row_at[r + 1]].split(b"\n") if x.strip()]
                out["n_lines"][words.first + r] = len(lines)
                out["n_dup_lines"][words.first + r] = len(lines) - len(set(lines))
                out["n_repeat_words"][words.first + r] = repeat_words(words.hashes[words.at[r] : words.at[r + 1]])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(out[c]) for c in STATS)], [*batch.schema.names[:-1], *STATS])
    K.release()


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus the counts STATS of the text; columns of docs with these names are replaced. Null: all 0."""
    docs = docs.drop(*STATS)
    plain = docs.withColumn("__bytes", text_bytes(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return plain.mapInArrow(_stats, ", ".join([*([schema] if schema else []), *(f"{c} long" for c in STATS)]))


def rule_failures() -> dict[str, F.Column]:
    """The rules, on the columns STATS."""
    return {
        "short": F.col("n_words") < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > 10 * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    }


def host_verdicts(checked: DataFrame, host: str, max_rate: float) -> DataFrame:
    """(host_key, n_docs, n_failed, rate, reject) by host of rows with a boolean ``failed``.

    The prior is beta(a, b) with the mean m of all documents and the strength that the hosts' rates show: with v their
    variance around m, weighted by documents and less what sampling alone gives, a + b = m (1 - m) / v - 1, between 1 and
    10,000. A host of a few documents stays near m; a large one keeps its own rate.
    """
    hosts = checked.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host_key")).agg(
        F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("h"))
    total = total.withColumn("m", F.col("f") / F.col("n"))
    spread = hosts.crossJoin(F.broadcast(total)).groupBy("n", "h", "m").agg(
        F.sum(F.col("n_docs") * F.pow(F.col("n_failed") / F.col("n_docs") - F.col("m"), 2)).alias("q"))
    v = F.col("q") / F.col("n") - F.col("m") * (1 - F.col("m")) * F.col("h") / F.col("n")
    strength = F.when(v > 0, F.least(F.lit(10000.0), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / v - 1))).otherwise(F.lit(10000.0))
    prior = spread.select("m", strength.alias("s"))  # one row
    rate = (F.col("n_failed") + F.col("m") * F.col("s")) / (F.col("n_docs") + F.col("s"))
    return hosts.crossJoin(F.broadcast(prior)).select("host_key", "n_docs", "n_failed", rate.alias("rate"), (rate > max_rate).alias("reject"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = 0.5) -> DataFrame:
    """docs plus STATS, base_failed (too short or too repetitive), failed (any rule), host_rejected and kept.

    A document is kept if it does not fail the base rules and its host's shrunken failure rate over all rules is at most
    ``max_rate``. Null or empty texts have 0 words and fail. A null host counts as the host of empty name. Repeated rows
    count and are judged each. An empty table gives no rows. Added columns replace those of docs with the same names.

    Two passes over the texts: one that leaves a row per host (pre-aggregated before its shuffle), one that judges; so no
    text is ever shuffled for its own sake. Only rejected hosts are joined back, written out first so that their size is known:
    few are broadcast, for many Spark shuffles and splits a hot host.
    """
    docs = docs.drop("base_failed", "failed", "host_rejected", "kept", "__host")
    rules = rule_failures()
    failed = rules["short"] | rules["repeats"] | rules["symbols"] | rules["lines"]
    hosts = host_verdicts(with_stats(docs.select(host, text), text).select(host, failed.alias("failed")), host, max_rate)
    bad = stored(hosts.where("reject").select(F.col("host_key").alias("__host"), F.lit(True).alias("host_rejected")), "rejected-hosts")
    out = with_stats(docs, text).withColumns({"base_failed": rules["short"] | rules["repeats"], "failed": failed})
    out = out.join(bad, F.coalesce(F.col(host).cast("string"), F.lit("")) == F.col("__host"), "left").drop("__host")
    out = out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs, whatever they are called."""
    plain, back = set_aside(docs)
    name = {n: c for c, n in back.items()}
    return judge(plain, name[host], name[text]).where("kept").select(*[F.col(c).alias(n) for c, n in back.items()])
