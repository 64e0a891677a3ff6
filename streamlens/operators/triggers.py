"""Jobs built on the trigger fold: suppression while a call runs, and budget-matched timers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.operators.fold import fold
from streamlens.operators.layout import Laid, join_on
from streamlens.operators.policies import FixedInterval, Policy, SignalThreshold, Trigger
from streamlens.operators.scoring import mark_fired


def decisions(laid: Laid, policies: list[Policy]) -> DataFrame:
    """Fired rows per policy: ``keys, policy, point, frame_idx, t, score``."""
    return fold(laid, Trigger(policies))


def in_flight(laid: Laid, policy: SignalThreshold, service_s: float) -> Laid:
    """Rows the policy picks, as ``started`` or, while the previous call still runs, ``worker_busy``.

    A busy trigger leaves the policy untouched, so the started calls are those of a gap as long as
    the longer of the two waits.
    """
    gap = max(policy.min_gap_s, service_s)
    started = SignalThreshold(policy.kind, policy.signal, policy.threshold, gap)
    marked = mark_fired(laid, decisions(laid, [started]))
    marked = marked.last(_call=F.when(F.col("fired"), F.col("t"))).lag(_before="_call")
    age = F.col("t") - F.col("_before")
    busy = ~F.col("fired") & (F.col(policy.signal) >= policy.threshold) & (age >= policy.min_gap_s) & (age < service_s)
    return marked.transform(
        lambda d: d.withColumn("outcome", F.when(F.col("fired"), F.lit("started")).when(busy, F.lit("worker_busy")))
        .filter("outcome is not null").drop("_call", "_before", "fired"))


def calls_per_minute(laid: Laid, fired: DataFrame) -> DataFrame:
    """Measured call rate of each stream over its own elapsed time."""
    keys = list(laid.keys)
    span = laid.df.groupBy(*keys).agg(((F.max("t") - F.min("t")) / 60.0).alias("minutes"))
    n = fired.groupBy(*keys).agg(F.count("*").alias("n_calls"))
    return join_on(span, n, keys, "left").select(*keys, "n_calls", F.try_divide(F.col("n_calls"), F.col("minutes")).alias("calls_per_min"))


def matched_timer(laid: Laid, fired: DataFrame) -> FixedInterval:
    """Timer whose period spends the budget another policy was measured to spend."""
    rate = calls_per_minute(laid, fired).agg(F.avg("calls_per_min")).first()[0]
    if not rate:
        raise ValueError("the measured policy made no calls; there is no budget to match")
    return FixedInterval(60.0 / rate)
