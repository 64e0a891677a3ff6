"""Exact percentiles and rank statistics.

Small groups use Spark's exact ``percentile``. Its buffer holds every distinct value of a group, so a
group too large for one task goes through a value histogram (pre-aggregated before the shuffle) and a
running count over it instead; the answers are the same. AUC always goes through the histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.operators.layout import Laid, join_on, lay_out


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              within: Laid | None = None) -> DataFrame:
    """``keys`` + ``q_0, q_1, ...`` by linear interpolation. NULL values are ignored."""
    keys = list(keys)
    df = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    if not lay_out(df, keys, ["_v"], within=within).split:
        arr = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]))
        out = df.groupBy(*keys).agg(arr.alias("_q"))
        out = out.filter("_q is not null")
        return out.select(*keys, *[F.col("_q")[i].alias(f"q_{i}") for i in range(len(probs))])
    return _from_histogram(df, keys, probs)


def quantiles_where(df: DataFrame, keys: Sequence[str], value: str, which: dict[str, tuple], within: Laid | None = None) -> DataFrame:
    """Several percentiles, each over the rows its condition picks: name -> (condition, probability)."""
    keys = list(keys)
    if not lay_out(df.select(*keys, value), keys, [value], within=within).split:
        return df.groupBy(*keys).agg(*[
            F.percentile(F.when(c, F.col(value).cast("double")), F.lit(float(p))).alias(n) for n, (c, p) in which.items()])
    out = df.select(*keys).distinct()
    for n, (c, p) in which.items():
        one = quantiles(df.filter(c), keys, value, [p]).withColumnRenamed("q_0", n)
        out = join_on(out, one, keys, "left") if keys else out.crossJoin(one)
    return out


def _from_histogram(df: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    hist = df.groupBy(*keys, "_v").agg(F.count("*").alias("_k"))
    laid = lay_out(hist, keys, ["_v"]).running(_upto="_k")
    n = hist.groupBy(*keys).agg(F.sum("_k").alias("_n"))
    rows = _attach(laid.result(), n, keys)
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("_upto") - F.col("_k") <= at) & (at < F.col("_upto"))
            aggs.append(F.max(F.when(inside, F.col("_v"))).alias(f"{tag}_{i}"))
    out = rows.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    cols = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        frac = pos - F.floor(pos)
        cols.append((F.col(f"lo_{i}") * (1 - frac) + F.col(f"hi_{i}") * frac).alias(f"q_{i}"))
    return out.select(*keys, *cols)


# The percentiles of a latency block.
BLOCK = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def percentile_block(df: DataFrame, keys: Sequence[str], value: str, within: Laid | None = None) -> DataFrame:
    """n, mean, p50, p95, p99, min, max, std (population) per key; keys without values have no row."""
    keys = list(keys)
    v = F.col("_v")
    df = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    plain = [
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.stddev_pop(v).alias("std"),
    ]
    if not lay_out(df, keys, ["_v"], within=within).split:
        arr = F.percentile("_v", F.array(*[F.lit(p) for p in BLOCK.values()]))
        out = df.groupBy(*keys).agg(*plain, arr.alias("_q")).filter("n > 0")
        qs = [F.col("_q")[i].alias(k) for i, k in enumerate(BLOCK)]
        return out.select(*keys, "n", "mean", *qs, "min", "max", "std")
    q = _from_histogram(df, keys, list(BLOCK.values()))
    for i, k in enumerate(BLOCK):
        q = q.withColumnRenamed(f"q_{i}", k)
    base = df.groupBy(*keys).agg(*plain)
    out = _attach(base, q, keys)
    return out.select(*keys, "n", "mean", *BLOCK, "min", "max", "std")


def auc(df: DataFrame, keys: Sequence[str], score: str, positive: str, within: Laid | None = None) -> DataFrame:
    """ROC AUC with average ranks for ties; NULL when one class is empty.

    Sum over distinct scores of positives x (negatives below + half the negatives at the score).
    """
    keys = list(keys)
    flag = F.col(positive).cast("boolean")
    hist = df.filter(F.col(score).isNotNull() & flag.isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("_v")).agg(
        F.sum(F.when(flag, 1.0).otherwise(0.0)).alias("_pos"), F.sum(F.when(flag, 0.0).otherwise(1.0)).alias("_neg"),
    )
    laid = lay_out(hist, keys, ["_v"], within=within).running(_below="_neg")
    below = F.col("_below") - F.col("_neg")
    return laid.df.groupBy(*keys).agg(
        F.sum(F.col("_pos") * (below + F.col("_neg") / 2.0)).alias("_u"),
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"),
    ).select(*keys, F.try_divide(F.col("_u"), F.col("_p") * F.col("_n")).alias("auc"),
             F.col("_p").cast("long").alias("n_pos"), F.col("_n").cast("long").alias("n_neg"))


def _attach(df: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Join one row per key; without keys there is exactly one row, found by a constant."""
    if keys:
        return join_on(df, per_key, keys)
    one = F.lit(1)
    return df.withColumn("_one", one).join(F.broadcast(per_key.withColumn("_one", one)), "_one").drop("_one")
