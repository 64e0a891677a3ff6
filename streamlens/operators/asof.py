"""As-of questions: answer from evidence that already existed, and prove that nothing else was used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.operators.layout import Laid, lay_out


def asof(queries: DataFrame, evidence: DataFrame, keys: list[str], carry: list[str], *,
         q_time: str = "t", e_time: str = "t", q_tie: str, e_tie: str, within: Laid | None = None) -> DataFrame:
    """Latest evidence with ``e_time <= q_time`` per query; unanswered queries keep NULLs.

    One union and one ordered carry, no inequality join. Among evidence of equal time the one with
    the largest ``e_tie`` counts, compared as what it is (9 comes before 10).
    """
    e = evidence.select(
        *keys, F.col(e_time).alias("_t"), F.lit(0).alias("_side"), F.col(e_tie).alias("_etie"),
        F.struct(F.col(e_time).alias("evidence_t"), *carry).alias("_e"),
    )
    q_cols = [c for c in queries.columns if c not in keys]
    q = queries.select(
        *keys, F.col(q_time).alias("_t"), F.lit(1).alias("_side"), F.col(q_tie).alias("_qtie"),
        F.struct(*q_cols).alias("_q"),
    )
    both = e.unionByName(q, allowMissingColumns=True)
    laid = lay_out(both, keys, ["_t", "_side", "_etie", "_qtie"], within=within).last(_ev="_e")
    return laid.df.filter("_side = 1").select(
        *keys, *[F.col("_q")[c].alias(c) for c in q_cols], F.col("_ev.evidence_t").alias("evidence_t"),
        *[F.col("_ev")[c].alias(c) for c in carry],
    )


def future_evidence(answered: DataFrame, q_time: str = "t", e_time: str = "evidence_t",
                    tolerance: float = 1e-9, strict: bool = False) -> DataFrame:
    """Answers that used evidence from after their question. ``strict`` fails the job instead."""
    bad = F.col(e_time) > F.col(q_time) + F.lit(tolerance)
    out = answered.filter(bad).withColumn("ahead_s", F.col(e_time) - F.col(q_time))
    if strict:
        out = out.withColumn("ahead_s", F.raise_error(F.lit("answer uses evidence from the future")).cast("double"))
    return out


def due(queries: DataFrame, answered: DataFrame, now: Column, query_id: str = "query_id") -> DataFrame:
    """Questions whose time has come and that have no answer yet."""
    return queries.filter(F.col("t") <= now).join(answered.select(query_id), query_id, "left_anti")


def coverage(transitions: DataFrame, calls: DataFrame, keys: list[str], state: str = "state_id",
             within: Laid | None = None) -> DataFrame:
    """First call at or after each transition made in the state it led to; NULL when missed.

    A forward as-of on (keys, state): rows here are transitions and calls only.
    """
    tr = transitions.select(*keys, state, F.col("frame_idx").alias("_f"), F.lit(1).alias("_side"),
                            F.col("frame_idx").alias("event_frame"))
    ca = calls.select(*keys, state, F.col("frame_idx").alias("_f"), F.lit(0).alias("_side"),
                      F.col("frame_idx").alias("_call"))
    both = tr.unionByName(ca, allowMissingColumns=True).withColumn("_back", -F.col("_f"))
    laid = lay_out(both, [*keys, state], ["_back", "_side"], within=within).last(covered_at="_call")
    return laid.df.filter("_side = 1").select(*keys, state, "event_frame", "covered_at")


def nearest(rows: DataFrame, events: DataFrame, keys: list[str], t: str, e_t: str, carry: str, row_id: str,
            within: Laid | None = None) -> DataFrame:
    """Value of the event nearest in time (earlier one on a tie); "unknown" where the key has none.

    Nearest is the closer of the last event before and the first one after, so two ordered carries
    replace a join of all pairs.
    """
    e = events.select(*keys, F.col(e_t).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(e_t).alias("et"), F.col(carry).alias("v")).alias("_e"))
    r_cols = [c for c in rows.columns if c not in keys]
    r = rows.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*r_cols).alias("_r"), F.col(row_id).alias("_id"))
    both = e.unionByName(r, allowMissingColumns=True).withColumn("_back", -F.col("_t"))
    before = lay_out(both, keys, ["_t", "_side", "_id"], within=within).last(_before="_e").result()
    after = lay_out(before, keys, ["_back", "_side", "_id"], within=within).last(_after="_e")
    gap_b, gap_a = F.col("_t") - F.col("_before.et"), F.col("_after.et") - F.col("_t")
    pick = F.when(gap_a.isNull() | (gap_b <= gap_a), F.col("_before.v")).otherwise(F.col("_after.v"))
    return after.df.filter("_side = 1").select(
        *keys, *[F.col("_r")[c].alias(c) for c in r_cols], F.coalesce(pick, F.lit("unknown")).alias("nearest_event")
    )


def query_schedule(durations: DataFrame, keys: list[str], every: float, duration: str = "duration_s") -> DataFrame:
    """One question every ``every`` seconds, strictly before the end of each stream."""
    last = F.col(duration) - F.lit(1e-6)
    n = F.greatest(F.lit(0), F.ceil(last / F.lit(every)) - 1).cast("long")
    i = F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>")))
    out = durations.select(*keys, duration, i.alias("_i"))
    return out.select(
        *keys, F.concat(F.lit("q"), (F.col("_i") - 1).cast("string")).alias("query_id"),
        (F.col("_i") * F.lit(float(every))).alias("t"),
    )


def timeline_summary(answered: DataFrame, keys: list[str]) -> DataFrame:
    stale = F.col("t") - F.col("evidence_t")
    return answered.groupBy(*keys).agg(
        F.count("*").alias("n_queries"), F.count("evidence_t").alias("n_answered"),
        F.count_if(F.col("evidence_t").isNull()).alias("n_unanswered"),
        F.avg(stale).alias("staleness_s_mean"), F.max(stale).alias("staleness_s_max"),
        F.count_if(F.col("evidence_t") > F.col("t") + 1e-9).alias("future_evidence_violations"),
    )
