"""Run telemetry: latencies, rates, energy and audits over narrow event tables keyed by run.

NULL means not measured and 0 means measured as zero, so nothing here fills a NULL with 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.operators.layout import Laid, join_on


def call_latencies(calls: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frame to first token and frame to answer; calls without a known frame drop out."""
    f = frames.select(*keys, "frame_id", F.col("t").alias("_t0"))
    return join_on(calls, f, [*keys, "frame_id"]).select(
        *keys, "call_id", "frame_id",
        ((F.col("t_first_token") - F.col("_t0")) * 1000.0).alias("first_token_ms"),
        ((F.col("t_complete") - F.col("_t0")) * 1000.0).alias("answer_ms"))


def answer_staleness(answers: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Age of the evidence behind each answer."""
    f = frames.select(*keys, F.col("frame_id").alias("evidence_frame_id"), F.col("t").alias("_t0"))
    return join_on(answers, f, [*keys, "evidence_frame_id"]).select(
        *keys, "answer_id", ((F.col("t") - F.col("_t0")) * 1000.0).alias("staleness_ms"))


def counts_and_rates(frames: DataFrame, drops: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Captured, dropped, drop rate, frames per second, calls per minute; NULL for a run of no length."""
    fr = frames.groupBy(*keys).agg(F.count("*").alias("captured"), (F.max("t") - F.min("t")).alias("duration_s"))
    dr = drops.groupBy(*keys).agg(F.count("*").alias("dropped"))
    ca = calls.groupBy(*keys).agg(F.count("*").alias("calls"))
    zero = F.lit(0).cast("long")
    out = join_on(join_on(fr, dr, keys, "left"), ca, keys, "left").withColumns(
        {"dropped": F.coalesce("dropped", zero), "calls": F.coalesce("calls", zero)})
    return out.withColumns({
        "drop_rate": F.try_divide(F.col("dropped"), F.col("captured") + F.col("dropped")),
        "achieved_fps": F.try_divide(F.col("captured"), F.col("duration_s")),
        "calls_per_min": F.try_divide(F.col("calls"), F.col("duration_s") / 60.0),
    })


def false_trigger_rate(triggers: DataFrame, by: list[str]) -> DataFrame:
    """Over fired rows that carry a label; unlabelled ones are counted apart."""
    fired, label = F.col("fired"), F.col("semantic_change")
    false_n = F.count_if(fired & (label == F.lit(False)))
    labelled = F.count_if(fired & label.isNotNull())
    return triggers.groupBy(*by).agg(
        F.try_divide(false_n, labelled).alias("rate"), false_n.alias("n_false"), labelled.alias("n_labelled"),
        F.count_if(fired & label.isNull()).alias("n_unlabelled"))


def agreement(records: DataFrame, by: list[str], correct: Column, fired: Column) -> DataFrame:
    return records.groupBy(*by).agg(
        F.avg(correct.cast("double")).alias("accuracy_vs_oracle"), F.count("*").alias("decisions"),
        F.count_if(fired).alias("fired"))


def queue_depth(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.groupBy(*by).agg(
        F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"), F.count("*").alias("n_samples"))


def depth_points(samples: Laid, t: str = "t", depth: str = "depth") -> DataFrame:
    """The depth of every queue over time: place in the series, seconds since its first sample, depth."""
    from streamlens.operators.signals import relative_time

    laid = relative_time(samples.row_number("point"), t)
    return laid.result().select(*samples.keys, "point", "t_rel", depth)


def energy(samples: Laid, baseline: Column | None = None, queries: DataFrame | None = None) -> DataFrame:
    """Trapezoid energy over each run; marginal = above the idle baseline, held at 0.

    NULL with fewer than two samples, and marginal NULL where no baseline was measured.
    """
    keys = list(samples.keys)
    above = F.greatest(F.lit(0.0), F.col("power_w") - baseline) if baseline is not None else F.lit(None).cast("double")
    laid = samples.transform(lambda d: d.withColumn("_m", above)).lag(_t="t", _w="power_w", _mw="_m")
    dt = F.col("t") - F.col("_t")
    out = laid.df.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.avg("power_w").alias("mean_w"), F.max("power_w").alias("peak_w"),
        F.sum(dt * (F.col("power_w") + F.col("_w")) / 2.0).alias("energy_j"),
        F.sum(dt * (F.col("_m") + F.col("_mw")) / 2.0).alias("energy_marginal_j"),
        F.avg("util_gpu_pct").alias("mean_util_pct"), F.max("temp_c").alias("peak_temp_c"))
    enough = F.col("n_samples") >= 2
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("mean_w", "peak_w")})
    if queries is not None:
        n = queries.groupBy(*keys).agg(F.count("*").alias("_q"))
        out = join_on(out, n, keys, "left").withColumns({
            "energy_per_query_j": F.try_divide(F.col("energy_j"), F.col("_q")),
            "energy_marginal_per_query_j": F.try_divide(F.col("energy_marginal_j"), F.col("_q")),
        }).drop("_q")
    return out


def memory(samples: DataFrame, by: list[str]) -> DataFrame:
    gib = float(1024**3)
    return samples.groupBy(*by).agg(
        (F.max("mem_used_b") / gib).alias("peak_used_gb"), (F.avg("mem_used_b") / gib).alias("mean_used_gb"))


def discrimination(distances: DataFrame, by: list[str]) -> DataFrame:
    """Median distance per perturbation kind and the two ratios; NULL where the base is ~0."""
    from streamlens.operators.quantiles import quantiles

    med = quantiles(distances, [*by, "kind"], "distance", [0.5])
    wide = med.groupBy(*by).pivot("kind", ["lighting", "motion", "semantic"]).agg(F.first("q_0"))
    return wide.select(
        *by, *[F.col(k).alias(f"d_{k}_median") for k in ("lighting", "motion", "semantic")],
        F.when(F.col("lighting") > 1e-9, F.col("semantic") / F.col("lighting")).alias("discrimination"),
        F.when(F.col("motion") > 1e-9, F.col("semantic") / F.col("motion")).alias("semantic_vs_motion"))


def config_bench(calls: DataFrame, by: list[str]) -> DataFrame:
    """Per configuration: TTFT incl. encoding (NULL where nothing was streamed), totals, tokens/s, memory."""
    from streamlens.operators.layout import lay_out
    from streamlens.operators.quantiles import quantiles

    rows = calls.withColumn("_ttft", F.col("ttft_ms") + F.col("encode_ms"))
    rate = F.when((F.col("n_tokens") > 0) & (F.col("total_ms") > 0), F.col("n_tokens") / (F.col("total_ms") / 1000.0))
    plain = [
        F.count("*").alias("n_calls"), F.min("_ttft").alias("ttft_min_ms"), F.avg(rate).alias("tokens_per_s"),
        F.max("mem_gb").alias("peak_mem_gb")]
    wanted = {"ttft": ("_ttft", [50, 95, 99]), "total": ("total_ms", [50, 95])}
    if not lay_out(rows, by, ["total_ms"]).split:
        exact = [F.percentile(c, F.lit(p / 100)).alias(f"{n}_p{p}_ms") for n, (c, ps) in wanted.items() for p in ps]
        return rows.groupBy(*by).agg(*plain, *exact)
    out = rows.groupBy(*by).agg(*plain)
    for n, (c, ps) in wanted.items():
        q = quantiles(rows, by, c, [p / 100 for p in ps])
        out = join_on(out, q.withColumnsRenamed({f"q_{i}": f"{n}_p{p}_ms" for i, p in enumerate(ps)}), by, "left")
    return out


def wall_clock_audit(log: DataFrame, keys: list[str], tolerance_s: float) -> DataFrame:
    """Did a replay ever deliver more rows than its clock allows, and how late were they?"""
    late = F.col("arrived_t") - F.col("frame_idx") / F.col("fps")
    out = log.groupBy(*keys).agg(
        F.count("*").alias("delivered"), F.max("arrived_t").alias("elapsed_s"),
        (F.max("arrived_t") * F.first("fps") + 1).alias("allowed"),
        F.count_if(late > tolerance_s).alias("rows_late"), F.max(late * 1000.0).alias("max_lateness_ms"))
    return out.withColumn("within_wall_clock", F.col("delivered") <= F.col("allowed"))


def wall_clock_verdict(audit: DataFrame) -> DataFrame:
    """One row over all streams of an audit: did every one stay within its clock?"""
    return audit.agg(
        F.count("*").alias("n_streams"), F.sum("delivered").alias("delivered"), F.sum("rows_late").alias("rows_late"),
        F.max("max_lateness_ms").alias("max_lateness_ms"), F.count_if(~F.col("within_wall_clock")).alias("n_beyond"),
        F.coalesce(F.bool_and("within_wall_clock"), F.lit(True)).alias("within_wall_clock"))


def budget(runs: DataFrame, cap_w: float) -> DataFrame:
    """Throughput deficit, kept and dropped share, power one call per frame would need."""
    calls_s = F.col("calls_per_min") / 60.0
    total = F.col("captured") + F.col("dropped")
    return runs.withColumns({
        "deficit_x": F.try_divide(F.col("achieved_fps"), calls_s),
        "kept_pct": F.try_divide(F.lit(100.0) * F.col("captured"), total),
        "dropped_pct": F.try_divide(F.lit(100.0) * F.col("dropped"), total),
        "achieved_w": calls_s * F.col("energy_per_query_j"),
        "per_frame_w": F.col("achieved_fps") * F.col("energy_per_query_j"),
        "over_cap_x": F.col("achieved_fps") * F.col("energy_per_query_j") / F.lit(cap_w),
    })


def event_counts(events: DataFrame, by: list[str], kind: str, kinds: list[str], cap: int) -> DataFrame:
    """Rows of each kind per run, and whether a recorder keeping ``cap`` rows would have truncated."""
    out = events.groupBy(*by).pivot(kind, kinds).agg(F.count(F.lit(1)))
    out = out.select(*by, *[F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) for k in kinds])
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    return out.withColumn("truncated", total > cap)
