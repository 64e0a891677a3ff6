"""Trace store: rows in Parquet, exchangeable with documents that hold one array per column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
PART_ROWS = 100_000  # rows of a stream one document may hold
ARRAYS = ["motion", "novelty", "scene_change", "state_id", "answer"]
SIGNALS = ("novelty", "novelty_patch", "motion", "scene_change")


def from_arrays(docs: DataFrame, columns: list[str] = ARRAYS) -> DataFrame:
    """Documents with one array per column -> rows; an unknown version stops the job."""
    ok = F.assert_true(F.col("schema_version") == VERSION, F.lit(f"trace version is not {VERSION}"))
    first = F.col("first_frame") if "first_frame" in docs.columns else F.lit(0)
    zipped = F.posexplode(F.arrays_zip(*columns)).alias("_i", "_z")
    rows = docs.withColumn("_ok", ok).filter("_ok is null").select("stream_id", "fps", first.cast("long").alias("_f"), zipped)
    idx = F.col("_f") + F.col("_i")
    return rows.select("stream_id", idx.alias("frame_idx"), (idx / F.col("fps")).alias("t"),
                       *[F.col("_z")[c].alias(c) for c in columns])


def to_arrays(rows: DataFrame, fps: float, columns: list[str] = ARRAYS, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows -> documents of at most ``part_rows`` rows; a long stream becomes several, in order."""
    part = F.floor(F.col("frame_idx") / part_rows)
    ordered = F.sort_array(F.collect_list(F.struct("frame_idx", *columns)))
    packed = rows.groupBy("stream_id", part.alias("_part")).agg(ordered.alias("_r"))
    return packed.select(
        "stream_id", F.col("_r")[0]["frame_idx"].alias("first_frame"), F.lit(float(fps)).alias("fps"),
        F.lit(VERSION).alias("schema_version"), *[F.col(f"_r.{c}").alias(c) for c in columns])


def save(rows: DataFrame, path: str, by_stream: bool = False) -> None:
    """``by_stream`` folders suit few long streams; many short ones are better clustered."""
    out = rows.withColumn("schema_version", F.lit(VERSION)).write.mode("errorifexists")
    (out.partitionBy("stream_id") if by_stream else out).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    ok = F.assert_true(F.col("schema_version") == VERSION, F.lit(f"trace version is not {VERSION}"))
    return rows.withColumn("_ok", ok).filter("_ok is null").drop("_ok", "schema_version")


def with_signal(rows: DataFrame, signal: str) -> DataFrame:
    """The same trace with another signal in the place of ``novelty``."""
    if signal == "pooled":
        return rows
    if signal not in rows.columns or signal not in SIGNALS:
        raise ValueError(f"unknown signal {signal!r}")
    return rows.withColumn("novelty", F.col(signal))


def blinded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lit(0.0) for c in ("motion", "novelty", "scene_change")})


def backfill(trace: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Add or replace signal columns; a row without a new value gets NULL there."""
    keys = ["stream_id", "frame_idx"]
    return trace.drop(*columns).join(new.select(*keys, *columns), keys, "left")


def missing(streams: DataFrame, existing: DataFrame, rebuild: bool = False) -> DataFrame:
    """Streams still to build; filter with this before the expensive map."""
    return streams if rebuild else streams.join(existing.select("stream_id").distinct(), "stream_id", "left_anti")
