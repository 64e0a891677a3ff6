"""Views of the star-schema test tables in the shape of streams, traces, calls, answers and power."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlens.operators.layout import Laid, lay_out


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def events(spark: SparkSession, path: str) -> DataFrame:
    """One stream per user; ``t`` in seconds, ``t_us`` the same instant in whole microseconds."""
    e = table(spark, path, "events")
    # ``ts`` is a wall clock without a zone: read it as UTC whatever zone the session is in.
    t_us = F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return e.select(
        F.col("user_id").alias("stream_id"), "event_id", t_us.alias("t_us"),
        (t_us / F.lit(1e6)).alias("t"), "event_type", "value",
    )


def events_laid(spark: SparkSession, path: str) -> Laid:
    return lay_out(events(spark, path), ["stream_id"], ["t_us", "event_id"])


# State number of each event type.
STATE_OF = {"click": 0, "view": 1, "purchase": 2, "signup": 3, "error": 4}


def state_code(event_type) -> F.Column:
    code = F.lit(-1)
    for name, n in STATE_OF.items():
        code = F.when(event_type == name, F.lit(n)).otherwise(code)
    return code


def trace(spark: SparkSession, path: str) -> Laid:
    """Trace rows: signals, state and answer per row of each stream, in order."""
    laid = events_laid(spark, path)
    laid = laid.row_number("frame_idx").lag(_prev="value")
    jump = F.coalesce(F.abs(F.col("value") - F.col("_prev")) / 500.0, F.lit(0.0))
    df = laid.df.select(
        *laid.parts, "frame_idx", "t_us", "event_id", "t",
        jump.alias("motion"),
        (F.col("value") / 500.0).alias("novelty"),
        F.lit(0.0).alias("scene_change"),
        state_code(F.col("event_type")).alias("state_id"),
        F.concat_ws(" ", F.lit("user did"), "event_type", F.lit("today"), F.format_string("v%d", (F.col("value") / 100).cast("int"))).alias("answer"),
    )
    return laid.with_df(df)


def frames(spark: SparkSession, path: str, n_streams: int | None = None, fps: float = 30.0) -> Laid:
    """Embedding frames: interleaved streams at 30 rows a second, as many as 100,000 rows each ask for, ten at least."""
    e = table(spark, path, "embeddings")
    n_streams = n_streams or max(10, -(-e.count() // 100_000))
    idx = F.floor(F.col("vec_id") / n_streams).cast("long")
    df = e.select(
        (F.col("vec_id") % n_streams).cast("long").alias("stream_id"),
        idx.alias("frame_idx"), (idx / F.lit(fps)).alias("t"),
        F.col("embedding"), F.col("label").alias("state_id"),
    )
    return lay_out(df, ["stream_id"], ["frame_idx"])


def cells(emb, n_cells: int):
    """Cut a vector into ``n_cells`` equal slices, each made unit length."""
    from streamlens.functions.vec import l2_normalise

    size = F.size(emb) / n_cells
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_cells - 1)),
        lambda i: l2_normalise(F.slice(emb, (i * size + 1).cast("int"), size.cast("int"))),
    )


def call_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, calls, answers) of each run; every 97th call names a frame that does not exist."""
    e = events(spark, path)
    fr = e.select(F.col("stream_id").alias("run_id"), F.col("event_id").alias("frame_id"), "t")
    clicks = e.filter(F.col("event_type") == "click")
    calls = clicks.select(
        F.col("stream_id").alias("run_id"),
        F.concat(F.lit("c"), F.col("event_id")).alias("call_id"),
        F.when(F.col("event_id") % 97 == 0, F.col("event_id") + 1_000_000_000)
        .otherwise(F.col("event_id")).alias("frame_id"),
        F.col("t").alias("t_start"),
        (F.col("t") + F.col("value") / 1000.0).alias("t_first_token"),
        (F.col("t") + F.col("value") * 3.0 / 1000.0).alias("t_complete"),
        F.lit("model").alias("model"),
    )
    answers = clicks.select(
        F.col("stream_id").alias("run_id"), F.concat(F.lit("a"), F.col("event_id")).alias("answer_id"),
        F.col("event_id").alias("evidence_frame_id"), (F.col("t") + F.col("value") * 3.0 / 1000.0).alias("t"),
    )
    return fr, calls, answers


def power_samples(spark: SparkSession, path: str) -> Laid:
    laid = events_laid(spark, path)
    df = laid.df.select(
        *laid.parts, "t_us", "event_id", "t", F.col("value").alias("power_w"),
        (F.col("value") * 1e7).cast("long").alias("mem_used_b"),
        F.floor(F.col("value") % 100).cast("int").alias("util_gpu_pct"),
        F.floor(F.col("value") % 40 + 40).cast("int").alias("temp_c"),
    )
    return laid.with_df(df)
