"""Scoring a policy's decisions against the trace: validity, agreement, staleness, events."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamlens.functions.text import bag_f1, content_words
from streamlens.operators import signals
from streamlens.operators.layout import Laid, join_on
from streamlens.operators.quantiles import auc, quantiles, quantiles_where


def mark_fired(trace: Laid, decisions: DataFrame) -> Laid:
    """Flag the trace rows one policy fired on."""
    keys = list(trace.keys)
    hits = decisions.select(*keys, "frame_idx", F.lit(True).alias("_hit"))
    df = join_on(trace.df, hits, [*keys, "frame_idx"], "left")
    return trace.with_df(df.withColumn("fired", F.coalesce("_hit", F.lit(False))).drop("_hit"))


def with_held(trace: Laid, fps: float, carry: tuple[str, ...] = ()) -> Laid:
    """Held frame and state of every row, with validity and staleness; ``carry`` names more columns."""
    held = signals.held_answer(trace, F.col("fired"), ["frame_idx", "state_id", *carry])
    return held.transform(
        lambda d: d.withColumns({
            "valid": F.coalesce(F.col("held_state_id") == F.col("state_id"), F.lit(False)),
            "staleness_ms": signals.staleness_ms(F.col("frame_idx"), F.col("held_frame_idx"), fps),
        })
    )


def with_coverage(trace: Laid) -> Laid:
    """``moved``: the state differs from the previous row's; ``covered_at``: on such rows the first
    call at or after them made in the new state.

    Looked up inside (stream, state), which the exchange on the stream already keeps together.
    """
    trace = trace.lag(_ps="state_id").transform(
        lambda d: d.withColumn("moved", F.coalesce(F.col("state_id") != F.col("_ps"), F.lit(False))).drop("_ps"))
    by_state = replace(trace, keys=(*trace.keys, "state_id"))
    by_state = signals.next_value(by_state, F.when(F.col("fired"), F.col("frame_idx")), "covered_at")
    return trace.with_df(by_state.df.withColumn("covered_at", F.when(F.col("moved"), F.col("covered_at"))))


def score(trace: Laid, fps: float = 30.0, warmup: int = 15, with_text: bool = True) -> DataFrame:
    """Score per stream of a trace whose rows carry ``fired``: one pass and one aggregate."""
    keys = list(trace.keys)
    if with_text:  # words are found once per row and carried along, not found again per pair
        trace = trace.transform(lambda d: d.withColumn("_w", content_words(F.col("answer"))))
    laid = with_held(with_coverage(trace), fps, ("_w",) if with_text else ()).lag(_before="held_state_id")
    graded = F.col("frame_idx") >= warmup
    f1 = F.when(F.col("held__w").isNull(), F.lit(0.0)).otherwise(
        bag_f1(F.col("held__w"), F.col("_w"))) if with_text else F.lit(None).cast("double")
    rows = laid.df.withColumn("_s", F.when(graded, F.col("staleness_ms")))
    called, delay = F.col("fired") & F.col("_before").isNotNull(), F.col("covered_at") - F.col("frame_idx")
    p95 = [] if trace.split else [F.percentile("_s", F.lit(0.95)).alias("staleness_ms_p95")]
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if("fired").alias("n_calls"),
        F.avg(F.when(graded, F.col("valid").cast("double"))).alias("validity"),
        F.avg(F.when(graded, f1)).alias("accuracy"), F.avg("_s").alias("staleness_ms_mean"), *p95,
        F.count_if(called & (F.col("_before") == F.col("state_id"))).alias("false_triggers"),
        F.count_if(called & (F.col("_before") != F.col("state_id"))).alias("justified_calls"),
        F.count_if("moved").alias("total_events"), F.count("covered_at").alias("_cov"),
        F.avg(delay / F.lit(fps) * 1000.0).alias("detection_delay_ms_mean"),
    )
    if trace.split:
        q = quantiles(rows, keys, "_s", [0.95]).withColumnRenamed("q_0", "staleness_ms_p95")
        out = join_on(out, q, keys, "left")
    c = F.col
    return out.select(
        *keys, "n_rows", "n_calls",
        (c("n_calls") / (c("n_rows") / F.lit(fps) / 60.0)).alias("calls_per_min"),
        (c("n_calls") / c("n_rows")).alias("call_fraction"),
        "validity", "accuracy", "staleness_ms_mean", "staleness_ms_p95", "false_triggers", "justified_calls",
        F.try_divide(c("false_triggers"), c("false_triggers") + c("justified_calls")).alias("false_trigger_rate"),
        (c("total_events") - c("_cov")).alias("missed_events"), "total_events",
        F.try_divide(c("_cov"), c("total_events")).alias("event_recall"), "detection_delay_ms_mean",
    )


def across_streams(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population spread and minimum over streams; a NULL of one stream is left out. Scores with text agreement (they
    have a ``staleness_ms_p95``) also give those of accuracy."""
    text = [F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"), F.min("accuracy").alias("accuracy_min"),
            F.avg("staleness_ms_p95").alias("staleness_ms_p95_mean")] if "staleness_ms_p95" in scores.columns else []
    return scores.groupBy(*by).agg(
        *text,
        F.count("*").alias("n_streams"),
        F.avg("validity").alias("validity_mean"), F.stddev_pop("validity").alias("validity_std"),
        F.min("validity").alias("validity_min"),
        F.avg("calls_per_min").alias("calls_per_min_mean"), F.stddev_pop("calls_per_min").alias("calls_per_min_std"),
        F.avg("call_fraction").alias("call_fraction_mean"),
        F.avg("false_trigger_rate").alias("false_trigger_rate_mean"),
        F.avg("event_recall").alias("event_recall_mean"),
        F.avg("staleness_ms_mean").alias("staleness_ms_mean"),
    )


def with_splits(scores: DataFrame, held_out: Column) -> DataFrame:
    """One row per split a stream belongs to: ``all`` and one of ``held_out`` / ``train``."""
    part = F.when(held_out, F.lit("held_out")).otherwise(F.lit("train"))
    return scores.withColumn("split", F.explode(F.array(F.lit("all"), part)))


def versus(rows: DataFrame, base: Column, on: list[str], ratio: dict[str, str], delta: dict[str, str]) -> DataFrame:
    """Compare every row with the one base row of its ``on`` group (of the table when ``on`` is empty).

    ``ratio`` / ``delta``: new column -> column compared. NULL where the base is 0 or NULL.
    """
    cols = set(ratio.values()) | set(delta.values())
    if on:
        b = rows.filter(base).select(*on, *[F.col(c).alias("_b_" + c) for c in cols])
        both = join_on(rows, b, on, "left")
    else:
        b = rows.filter(base).agg(*[F.first(c).alias("_b_" + c) for c in cols]).withColumn("_one", F.lit(1))
        both = rows.withColumn("_one", F.lit(1)).join(F.broadcast(b), "_one").drop("_one")
    both = both.withColumns({n: F.try_divide(F.col(c), F.col("_b_" + c)) for n, c in ratio.items()})
    both = both.withColumns({n: F.col(c) - F.col("_b_" + c) for n, c in delta.items()})
    return both.drop(*["_b_" + c for c in cols])


def agreement_ceiling(trace: Laid) -> DataFrame:
    """Mean F1 of neighbouring answers given in the same state: what serving noise alone costs."""
    trace = trace.transform(lambda d: d.withColumn("_w", content_words(F.col("answer"))))
    laid = trace.lag(_pw="_w", _ps="state_id")
    pairs = laid.df.filter(F.col("_ps") == F.col("state_id"))
    return pairs.groupBy(*trace.keys).agg(
        F.avg(bag_f1(F.col("_pw"), F.col("_w"))).alias("ceiling"), F.count("*").alias("n_pairs"))


def attribute(trace: Laid, fps: float, warmup: int) -> Laid:
    """Cause of every row: warmup, valid, missed_event or detection_lag."""
    laid = with_held(with_coverage(trace), fps)
    laid = laid.last(_event=F.when(F.col("moved"), F.struct("frame_idx", "covered_at")))
    cause = (
        F.when(F.col("frame_idx") < warmup, F.lit("warmup")).when(F.col("valid"), F.lit("valid"))
        .when(F.col("_event.covered_at").isNull(), F.lit("missed_event")).otherwise(F.lit("detection_lag"))
    )
    return laid.transform(lambda d: d.withColumn("cause", cause).drop("_event"))


def cause_shares(attributed: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per cause for every stream and, in the row with NULL keys, for all of them."""
    counts = attributed.rollup(*keys).agg(
        *[F.count_if(F.col("cause") == c).alias(c) for c in ("warmup", "valid", "missed_event", "detection_lag")])
    invalid = F.col("missed_event") + F.col("detection_lag")
    return counts.withColumns({
        "invalid": invalid,
        "validity": F.try_divide(F.col("valid"), F.col("valid") + invalid),
        "pct_missed": F.try_divide(F.lit(100.0) * F.col("missed_event"), invalid),
        "pct_lag": F.try_divide(F.lit(100.0) * F.col("detection_lag"), invalid),
    })


def separability(trace: Laid, response: int, margin: int, warmup: int,
                 names=("novelty", "motion", "scene_change")) -> DataFrame:
    """Per stream and signal: AUC of event rows over quiet rows, and whether the median clears the noise."""
    keys = list(trace.keys)
    masked = signals.event_masks(trace, response, margin, warmup).df
    rows = masked.filter("is_event or is_quiet").select(
        *keys, "is_event", "is_quiet",
        F.explode(F.create_map(*[x for s in names for x in (F.lit(s), F.col(s).cast("double"))])).alias("signal", "v"),
    )
    by = [*keys, "signal"]
    a = auc(rows, by, "v", "is_event", within=trace)
    q = quantiles_where(rows, by, "v", {
        "event_median": (F.col("is_event"), 0.5), "quiet_p95": (F.col("is_quiet"), 0.95)}, within=trace)
    return (
        join_on(a, q, by, "left")
        .withColumnRenamed("n_pos", "n_event_rows").withColumnRenamed("n_neg", "n_quiet_rows")
        .withColumn("clears", F.col("event_median") > F.col("quiet_p95"))
    )


def headroom(curve: DataFrame, keys: list[str], bar: float) -> DataFrame:
    """One row: cheapest global threshold whose worst stream clears the bar, against each stream's own.

    ``curve``: keys, threshold, validity, calls_per_min, event_recall.
    """
    ok = F.col("validity") >= F.lit(bar)
    glob = (
        curve.groupBy("threshold").agg(
            F.min("validity").alias("_v"), F.avg("calls_per_min").alias("_c"), F.avg("event_recall").alias("_r"))
        .filter(F.col("_v") >= F.lit(bar))
        .agg(F.min(F.struct("_c", "threshold", "_v", "_r")).alias("_g"))
    )
    own = curve.groupBy(*keys).agg(F.min(F.when(ok, F.struct("calls_per_min", "threshold"))).alias("_o"))
    per = own.agg(
        F.count("*").alias("n_streams"), F.count("_o").alias("n_achievable"),
        F.avg("_o.calls_per_min").alias("per_stream_calls_per_min"),
        F.max("_o.threshold").alias("_hi"), F.min("_o.threshold").alias("_lo"),
    )
    one = F.lit(1)  # both sides are a single aggregate row
    both = per.withColumn("_one", one).join(F.broadcast(glob.withColumn("_one", one)), "_one").drop("_one")
    return both.select(
        F.lit(bar).alias("validity_bar"), F.col("_g.threshold").alias("global_threshold"),
        F.col("_g._c").alias("global_calls_per_min"), F.col("_g._v").alias("global_min_validity"),
        F.col("_g._r").alias("global_mean_recall"), "n_streams", "n_achievable",
        (F.col("n_streams") - F.col("n_achievable")).alias("n_unreachable"), "per_stream_calls_per_min",
        F.try_divide(F.col("_g._c"), F.col("per_stream_calls_per_min")).alias("headroom_x"),
        F.when(F.col("n_achievable") > 1, F.col("_hi") / F.greatest(F.lit(1e-9), F.col("_lo"))).alias("threshold_spread"),
    )


def stream_headroom(curve: DataFrame, keys: list[str], bar: float) -> DataFrame:
    """Each stream's own cheapest threshold that clears the bar, with what it costs and recalls; one that no threshold
    clears is unreachable and shows its best validity alone."""
    best = F.min(F.when(F.col("validity") >= F.lit(bar), F.struct("calls_per_min", "threshold", "validity", "event_recall")))
    own = curve.groupBy(*keys).agg(best.alias("_o"), F.max("validity").alias("best_validity"))
    return own.select(*keys, F.col("_o").isNotNull().alias("reachable"), "best_validity", F.col("_o.threshold").alias("threshold"),
                      F.col("_o.calls_per_min").alias("calls_per_min"), F.col("_o.event_recall").alias("event_recall"))


def diagnosis(separable: DataFrame, room: DataFrame, auc_bar: float = 0.65, room_bar: float = 1.2) -> DataFrame:
    """What limits the policy: the signal, the threshold, or neither."""
    novelty = separable.filter(F.col("signal") == "novelty").agg(
        F.avg("auc").alias("mean_auc"), F.count_if(F.col("clears")).alias("n_clearing"),
        F.count("*").alias("n_with_events"))
    one = F.lit(1)
    both = novelty.withColumn("_one", one).join(F.broadcast(room.withColumn("_one", one)), "_one")
    verdict = (
        F.when((F.col("n_unreachable") > 0) | (F.col("mean_auc") < auc_bar), F.lit("signal_problem"))
        .when(F.col("headroom_x").isNull() | (F.col("headroom_x") < room_bar), F.lit("neither"))
        .otherwise(F.lit("threshold_problem"))
    )
    return both.select("mean_auc", "n_clearing", "n_with_events", "n_unreachable", "headroom_x", verdict.alias("verdict"))


def oversampling(trace: Laid, timer_calls: DataFrame, t: str = "t") -> DataFrame:
    """Seconds per event and how often a timer samples each event; NULL where nothing ever happens."""
    keys = list(trace.keys)
    base = trace.df.groupBy(*keys).agg((F.max(t) - F.min(t)).alias("duration_s"))
    ev = signals.transitions(trace).df.groupBy(*keys).agg(F.count("*").alias("_e"))
    calls = timer_calls.groupBy(*keys).agg(F.count("*").alias("_c"))
    zero = F.lit(0).cast("long")
    out = join_on(join_on(base, ev, keys, "left"), calls, keys, "left").select(
        *keys, "duration_s", F.coalesce("_e", zero).alias("events"), F.coalesce("_c", zero).alias("timer_calls"))
    return out.withColumns({
        "s_per_event": F.try_divide(F.col("duration_s"), F.col("events")),
        "oversampling": F.try_divide(F.col("timer_calls"), F.col("events")),
    })


def rank_first(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """First row of each group in the given order (Spark pre-filters each task to its own first)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
