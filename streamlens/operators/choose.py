"""Choosing rows: cheapest under a bar, nearest a budget, subsets, conflation and thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamlens.operators.layout import join_on, lay_out
from streamlens.operators.scoring import rank_first


def cheapest(scores: DataFrame, by: list[str], bar: float, cost: str = "calls_per_min_mean",
             validity: str = "validity_mean") -> DataFrame:
    """Cheapest operating point of each group whose validity reaches the bar."""
    return rank_first(scores.filter(F.col(validity) >= bar), by, [cost, "point"])


def nearest_budget(scores: DataFrame, by: list[str], budget: float, keys: list[str]) -> DataFrame:
    """Point with some stream's cost closest to the budget, then the mean calls at that point."""
    target = scores.groupBy(*by).agg(
        F.min(F.struct(F.abs(F.col("calls_per_min") - budget).alias("d"), F.col("point"))).alias("_p"))
    picked = target.select(*by, F.col("_p.point").alias("point"))
    return scores.join(picked, [*by, "point"]).groupBy(*by, "point").agg(F.avg("n_calls").alias("mean_calls"))


def budget_subset(samples: DataFrame, sample: str, cost: str, budget: float) -> DataFrame:
    """Cheapest samples first until the budget is spent (candidates ascend, so a prefix is exact)."""
    laid = lay_out(samples, [], [cost, sample]).running(spent=cost)
    return laid.result().filter(F.col("spent") <= budget)


def best_under(scores: DataFrame, by: list[str], limit: Column, value: str) -> DataFrame:
    ok = scores.filter(limit)
    cols = [c for c in scores.columns if c not in by]
    return ok.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct(F.col(value), -F.col("point"))).alias("_b")).select(
        *by, *[F.col("_b")[c].alias(c) for c in cols])


def strided(df: DataFrame, keys: list[str], order: list[str], stride: int, first: int | None = None) -> DataFrame:
    """Every ``stride``-th row of each key, at most ``first`` of them."""
    laid = lay_out(df, keys, order).row_number("_n")
    out = laid.result().filter(F.col("_n") % stride == 0)
    if first is not None:
        out = out.filter(F.col("_n") / stride < first)
    return out.drop("_n")


def thin(df: DataFrame, by: list[str], order: list[str], keep: int = 1, newest: bool = True) -> DataFrame:
    """Mark what a backlog of ``keep`` rows per group retains; dropped rows carry a reason.

    Only the border row of each group is searched for (a top-``keep`` Spark prunes in every task
    before the shuffle); the rows themselves then meet that one border row in a join.
    """
    sort = [F.col(c).desc() if newest else F.col(c).asc() for c in order]
    top = df.select(*by, *order).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*sort))).filter(F.col("_r") <= keep)
    edge = F.min(F.struct(*order)) if newest else F.max(F.struct(*order))
    border = top.groupBy(*by).agg(edge.alias("_edge"))
    key = F.struct(*order)
    kept = key >= F.col("_edge") if newest else key <= F.col("_edge")
    reason = "superseded_by_newer" if keep == 1 and newest else "queue_full_drop_oldest" if newest else "queue_full_drop_newest"
    return join_on(df, border, by).withColumn("kept", kept).withColumn(
        "reason", F.when(~F.col("kept"), F.lit(reason))).drop("_edge")


def conflate(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return thin(df, by, order, 1, True)


def backlog_stats(marked: DataFrame, by: list[str], depth: str, t: str) -> DataFrame:
    return marked.groupBy(*by).agg(
        F.count_if("kept").alias("n_put"), F.count_if(~F.col("kept")).alias("n_dropped"),
        F.max(depth).alias("peak_depth"), F.max_by(depth, t).alias("final_depth"))
