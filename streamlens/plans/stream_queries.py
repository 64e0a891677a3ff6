"""Structured Streaming: each query replays a test table as a stream until it is consumed."""

from pyspark.sql import functions as F

from streamlens.operators.cache import CacheRun
from streamlens.operators.cadence import DepthAtCadence, depth_at_cadence
from streamlens.operators.fold import end_states, fold
from streamlens.operators.layout import lay_out
from streamlens.operators.policies import FixedInterval, Trigger, make_policy
from streamlens.operators.signals import Reference
from streamlens.plans.cache_queries import CACHE_ROWS, cache_rec, rounded_lookups
from streamlens.plans.join_queries import QE
from streamlens.plans.registry import EV, FR, query, r
from streamlens.plans.scalar import rd
from streamlens.plans.signal_queries import NOVELTY
from streamlens.plans.source_queries import scratch
from streamlens.plans.trigger_queries import GAP, NOVELTY_COND, fired_sql
from streamlens.sources import tables
from streamlens.streaming import state, windows


SPAN = "60 days"  # allowed delay: longer than the month the event table covers
STRETCH_S = 4 * 86_400.0  # state in stretches of a fifteenth of it: rows of a key are hours apart and wait for the whole delay


def replayed(spark, df, name, clock, per="stream_id", files=3, end=None):
    """Write ``df`` as files that follow each other in time and open them as a stream.

    One write per stretch of time; inside a stretch all rows of a ``per`` value share a file, so every
    key is replayed in order. A micro-batch takes as many files as a stretch has on average: larger tables
    make larger batches, not more of them. ``end`` is a last row far ahead that moves the watermark past the data,
    as the rows of later days would.
    """
    folder = scratch(spark, name)
    lo, hi = df.agg(F.min(clock), F.max(clock)).first()
    edges = [lo + (hi - lo) * i / files for i in range(files)] + [None]
    for i in range(files):
        part = df.filter(F.col(clock) >= edges[i])
        if edges[i + 1] is not None:
            part = part.filter(F.col(clock) < edges[i + 1])
        part.repartition(per).write.mode("append").parquet(folder)
    if end is not None:
        end.select(*df.columns).write.mode("append").parquet(folder)
    n = len(spark.read.schema(df.schema).parquet(folder).inputFiles())
    return windows.replay_source(spark, folder, df.schema, -(-n // files))


def collected(spark, df, name, mode="append"):
    return windows.run_to_parquet(df, scratch(spark, name), scratch(spark, name + "-state"), mode)


@query("a8_replay_source", f"WITH {FR} SELECT stream_id, frame_idx, {r('t', 't')} FROM fr")
def a8(spark, path):
    fr = tables.frames(spark, path).result().select("stream_id", "frame_idx", "t")
    out = collected(spark, replayed(spark, fr, "replay", "frame_idx"), "replay-out")
    return out.withColumn("t", F.round("t", 6))


@query("a8_replay_loop", f"WITH {FR}, n AS (SELECT stream_id, max(frame_idx) + 1 AS n FROM fr GROUP BY 1) SELECT stream_id, frame_idx + k * n AS frame_idx, {r('t + k * n / 30.0::DOUBLE', 't')} FROM fr JOIN n USING (stream_id), (SELECT unnest(range(0, 3)) AS k)")
def a8_loop(spark, path):
    fr = tables.frames(spark, path).result().select("stream_id", "frame_idx", "t")
    rows = windows.looped(fr, ["stream_id"], 3, 30.0)
    out = collected(spark, replayed(spark, rows, "replay-loop", "frame_idx"), "replay-loop-out")
    return out.withColumn("t", F.round("t", 6))


@query("j1_stateful_signals", f"WITH {NOVELTY} SELECT stream_id, f AS frame_idx, {r('novelty', 'novelty')} FROM s")
def j1(spark, path):
    fr = tables.frames(spark, path).result()
    stream = replayed(spark, fr, "frames", "frame_idx")
    out = state.stream_fold(stream, Reference(2.0), ["stream_id"], ["frame_idx"])
    return collected(spark, out, "signals").withColumn("novelty", F.round("novelty", 6))


@query("j2_stateful_triggers", fired_sql(NOVELTY_COND, "'embedding_novelty'", [0.1, 0.3]))
def j2(spark, path):
    kernel = Trigger([make_policy("embedding_novelty", v, min_gap_s=GAP) for v in (0.1, 0.3)])
    stream = replayed(spark, tables.trace(spark, path).result(), "trace", "t_us")
    out = state.stream_fold(stream, kernel, ["stream_id"], ["t_us", "event_id"])
    return collected(spark, out, "triggers").select("stream_id", "policy", "point", "frame_idx")


@query("j2_triggers_out_of_order", fired_sql(NOVELTY_COND, "'embedding_novelty'", [0.1, 0.3]))
def j2_held(spark, path):
    """Files arrive newest stretch first; rows wait for the watermark and are folded in event order."""
    kernel = Trigger([make_policy("embedding_novelty", v, min_gap_s=GAP) for v in (0.1, 0.3)])
    tr = tables.trace(spark, path).result().withColumn("ts", F.timestamp_micros("t_us")).withColumn("_back", -F.col("t_us"))
    end = tr.agg(F.max("t_us").alias("m")).select(
        F.lit(-1).cast("long").alias("stream_id"), *[F.lit(0).cast("long").alias(c) for c in ("frame_idx", "event_id")],
        *[F.lit(0.0).alias(c) for c in ("t", "motion", "novelty", "scene_change")], F.lit(0).alias("state_id"), F.lit("").alias("answer"),
        (F.col("m") + 120 * 86_400_000_000).alias("t_us")).withColumn("ts", F.timestamp_micros("t_us")).withColumn("_back", F.lit(0).cast("long"))
    stream = replayed(spark, tr, "trace-back", "_back", end=end).withWatermark("ts", SPAN)
    out = state.stream_fold(stream, kernel, ["stream_id"], ["t_us", "event_id"], hold="ts", bucket_s=STRETCH_S)
    return collected(spark, out, "triggers-held").select("stream_id", "policy", "point", "frame_idx")


@query("j1_batch_then_stream", f"WITH {NOVELTY} SELECT stream_id, f AS frame_idx, {r('novelty', 'novelty')} FROM s")
def j1_handed_over(spark, path):
    """The first half of every stream in batch; a stream over the rest goes on from the states the batch ended in."""
    fr = tables.frames(spark, path)
    half = fr.df.agg(F.expr("max(frame_idx) div 2")).first()[0] or 0
    before = lay_out(fr.result().where(F.col("frame_idx") < half), ["stream_id"], ["frame_idx"], within=fr)
    stream = replayed(spark, fr.result().where(F.col("frame_idx") >= half), "frames-half", "frame_idx")
    out = state.stream_fold(stream, Reference(2.0), ["stream_id"], ["frame_idx"], start=end_states(before, Reference(2.0)))
    cols = ["stream_id", "frame_idx", "novelty"]
    return fold(before, Reference(2.0)).select(*cols).unionByName(collected(spark, out, "signals-half").select(*cols)).withColumn("novelty", F.round("novelty", 6))


@query("j2_batch_then_stream", fired_sql(NOVELTY_COND, "'embedding_novelty'", [0.1, 0.3]))
def j2_handed_over(spark, path):
    kernel = Trigger([make_policy("embedding_novelty", v, min_gap_s=GAP) for v in (0.1, 0.3)])
    tr = tables.trace(spark, path)
    lo, hi = tr.df.agg(F.min("t_us"), F.max("t_us")).first()
    cut = (lo + hi) // 2
    before = lay_out(tr.result().where(F.col("t_us") < cut), ["stream_id"], ["t_us", "event_id"], within=tr)
    stream = replayed(spark, tr.result().where(F.col("t_us") >= cut), "trace-half", "t_us")
    out = state.stream_fold(stream, kernel, ["stream_id"], ["t_us", "event_id"], start=end_states(before, kernel))
    cols = ["stream_id", "policy", "point", "frame_idx"]
    return fold(before, kernel).select(*cols).unionByName(collected(spark, out, "triggers-half").select(*cols))


@query("j3_stateful_cache", f"WITH {cache_rec('[0.1, 0.2]')} SELECT {CACHE_ROWS} FROM c")
def j3(spark, path):
    zero = F.lit(0.0)
    fr = tables.frames(spark, path).result().withColumns(
        {"motion": zero, "novelty": zero, "scene_change": zero, "state_id": F.col("state_id").cast("long")})
    stream = replayed(spark, fr, "cache-frames", "frame_idx")
    out = state.stream_fold(stream, CacheRun(FixedInterval(0.1), [0.1, 0.2], 8, 1.0), ["stream_id"], ["frame_idx"])
    return rounded_lookups(collected(spark, out, "cache"))


@query("j4_streaming_asof", f"WITH {QE}, l AS (SELECT max(t) AS m FROM ev) SELECT stream_id, CAST(query_id AS VARCHAR) AS query_id, evidence_id AS frame_idx FROM ans")
def j4(spark, path):
    e = tables.events(spark, path).withColumn("ts", F.timestamp_micros("t_us"))
    end = e.agg(F.max("t_us").alias("t_us")).select(
        *[F.lit(-1).cast("long").alias(c) for c in ("stream_id", "event_id")], (F.col("t_us") + 120 * 86_400_000_000).alias("t_us"),
        F.lit(0.0).alias("t"), F.lit("purchase").alias("event_type"), F.lit(0.0).alias("value")).withColumn("ts", F.timestamp_micros("t_us"))
    rows = replayed(spark, e, "asof", "t_us", end=end)
    q = rows.filter("event_type = 'view'").select("stream_id", "ts", "t", F.col("event_id").cast("string").alias("query_id"))
    ev = rows.filter("event_type = 'purchase'").select("stream_id", "ts", "t", F.col("event_id").alias("frame_idx"), F.lit("a").alias("answer"))
    out = collected(spark, state.stream_asof(q, ev, ["stream_id"], "ts", SPAN, STRETCH_S), "asof-out")
    return out.select("stream_id", "query_id", "frame_idx")


@query("j5_late_rows", f"WITH {EV}, x AS (SELECT event_id, CASE WHEN value / 100 <= 4 THEN value / 100 ELSE -value / 100 END AS late FROM ev) SELECT event_id, {r('late', 'lateness_s')}, late > 1 AS is_late, late < 0 AS is_future FROM x")
def j5(spark, path):
    e = tables.events(spark, path)
    us = F.round(F.col("value") / 100 * 1e6).cast("long")
    late = F.when(F.col("value") / 100 <= 4, us).otherwise(-us)  # the largest values claim to come from the future
    rows = e.select("event_id", F.timestamp_micros("t_us").alias("ts"), F.timestamp_micros(F.col("t_us") + late).alias("arrived"))
    out = windows.mark_late(replayed(spark, rows.withColumn("_us", F.unix_micros("arrived")), "late", "_us", "event_id"), "arrived", "ts", 1.0)
    return collected(spark, out, "late-out").select("event_id", rd(F.col("lateness_s"), "lateness_s"), "is_late", "is_future")


@query("j6_answered_once", f"WITH {EV} SELECT DISTINCT stream_id || '-' || CAST(floor(t / 86400) AS BIGINT) AS query_id FROM ev")
def j6(spark, path):
    e = tables.events(spark, path)
    qid = F.concat(F.col("stream_id"), F.lit("-"), F.floor(F.col("t") / 86400).cast("long"))
    rows = e.select(qid.alias("query_id"), F.timestamp_micros("t_us").alias("ts"), "t_us")
    out = windows.answered_once(replayed(spark, rows, "once", "t_us", "query_id"), "ts", SPAN)
    return collected(spark, out, "once-out").select("query_id")


TEL = f"WITH {EV} SELECT event_type, CAST(floor(t / 86400) AS BIGINT) AS day, count(*) AS rows, count(*) FILTER (value >= 100) AS calls, {r('avg(CAST(floor(value / 10) AS INTEGER))', 'mean_depth')}, max(CAST(floor(value / 10) AS INTEGER)) AS peak_depth FROM ev GROUP BY ALL"


def telemetry_rows(spark, path):
    e = tables.events(spark, path)
    return e.select("event_type", F.timestamp_micros("t_us").alias("ts"), (F.col("value") >= 100).alias("fired"), F.floor(F.col("value") / 10).cast("int").alias("depth"))


def by_day(d):
    return d.select("event_type", F.floor(F.unix_seconds("window_start") / 86400).cast("long").alias("day"), "rows", "calls", rd(F.col("mean_depth"), "mean_depth"), "peak_depth")


@query("j7_windowed_telemetry", TEL)
def j7(spark, path):
    return by_day(windows.telemetry(telemetry_rows(spark, path), "ts", ["event_type"], "1 day"))


@query("j7_windowed_telemetry_stream", TEL)
def j7_stream(spark, path):
    """The same windows from a stream. A window is out once the watermark passes its end; the last
    ones wait for later rows, which a marker row of a kind of its own stands for."""
    rows = telemetry_rows(spark, path).withColumn("_us", F.unix_micros("ts"))
    end = rows.agg(F.max("_us").alias("m")).select(
        F.lit("end of replay").alias("event_type"), F.timestamp_micros(F.col("m") + 120 * 86_400_000_000).alias("ts"), F.lit(False).alias("fired"),
        F.lit(0).alias("depth"), F.col("m").alias("_us"))
    stream = replayed(spark, rows, "telemetry", "_us", "event_type", end=end)
    out = collected(spark, windows.telemetry(stream, "ts", ["event_type"], "1 day", SPAN), "telemetry-out")
    return by_day(out.filter("event_type <> 'end of replay'"))


MINUTE, DAY_US = 60_000_000, 86_400_000_000
CADENCE = f"""WITH {EV}, d AS (SELECT event_type, t_us, arg_max(CAST(floor(value / 10) AS INTEGER), event_id) AS depth FROM ev GROUP BY 1, 2),
b AS (SELECT event_type, min(t_us) AS lo, max(t_us) AS hi FROM d GROUP BY 1),
k AS (SELECT event_type, hi, unnest(generate_series((lo + {MINUTE - 1}) // {MINUTE}, (hi - 1) // {MINUTE})) * {MINUTE} AS tick FROM b)
SELECT k.event_type, tick // {DAY_US} AS day, count(*) AS ticks, {r('avg(depth)', 'mean_depth')}, max(depth) AS peak_depth
FROM k ASOF JOIN d ON d.event_type = k.event_type AND d.t_us <= k.tick WHERE (tick // {DAY_US} + 1) * {DAY_US} <= hi GROUP BY ALL"""


def depth_rows(spark, path):
    return tables.events(spark, path).select("event_type", "t_us", "event_id", F.floor(F.col("value") / 10).cast("int").alias("depth"))


def depth_days(d):
    return d.select("event_type", F.expr(f"window_us div {DAY_US}").alias("day"), "ticks", rd(F.col("mean_depth"), "mean_depth"), "peak_depth")


@query("j7_depth_at_cadence", CADENCE)
def j7_cadence(spark, path):
    """Depth held between events and looked at once a minute, by day."""
    return depth_days(depth_at_cadence(lay_out(depth_rows(spark, path), ["event_type"], ["t_us", "event_id"]), DAY_US, MINUTE))


@query("j7_depth_at_cadence_stream", CADENCE)
def j7_cadence_stream(spark, path):
    """The same from a stream whose files come newest first: rows wait for the watermark."""
    rows = depth_rows(spark, path).withColumn("ts", F.timestamp_micros("t_us")).withColumn("_back", -F.col("t_us"))
    end = rows.agg(F.max("t_us").alias("m")).select(
        F.lit("end of replay").alias("event_type"), (F.col("m") + 120 * DAY_US).alias("t_us"), F.lit(0).cast("long").alias("event_id"), F.lit(0).alias("depth")).withColumn(
        "ts", F.timestamp_micros("t_us")).withColumn("_back", F.lit(0).cast("long"))
    stream = replayed(spark, rows, "depth", "_back", "event_type", end=end).withWatermark("ts", SPAN)
    out = state.stream_fold(stream, DepthAtCadence(DAY_US, MINUTE), ["event_type"], ["t_us", "event_id"], hold="ts", bucket_s=86_400.0)
    return depth_days(collected(spark, out, "depth-out").where("event_type <> 'end of replay'"))


@query("j8_thin_batches", f"WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY stream_id, CAST(floor(t / 86400) AS BIGINT) ORDER BY t_us DESC, event_id DESC) <= 2 AS kept FROM ev")
def j8(spark, path):
    e = tables.events(spark, path).select("stream_id", "event_id", "t_us", F.floor(F.col("t") / 86400).cast("long").alias("tick"))
    kept, dropped = scratch(spark, "kept"), scratch(spark, "dropped")
    # One file per batch and whole ticks per batch: thinning is per micro-batch.
    windows.thin_batches(replayed(spark, e, "thin", "tick"), ["stream_id", "tick"], ["t_us", "event_id"], 2, True, kept, dropped, scratch(spark, "thin-state")).awaitTermination()
    cols = [F.col("event_id")]
    return spark.read.parquet(kept).select(*cols, F.lit(True).alias("kept")).unionByName(spark.read.parquet(dropped).select(*cols, F.lit(False).alias("kept")))
