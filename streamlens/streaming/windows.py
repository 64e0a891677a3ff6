"""Streaming without custom state: replay source, late rows, windowed telemetry, thinning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from streamlens.operators.choose import thin
from streamlens.operators.layout import join_on


def replay_source(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """Recorded rows as a stream, oldest file first. Event time comes from the data, nothing sleeps."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .option("latestFirst", False).parquet(path)
    )


def looped(rows: DataFrame, keys: list[str], times: int, fps: float, frame: str = "frame_idx", t: str = "t") -> DataFrame:
    """The recorded rows ``times`` times over, as a source that starts again at its end would give them: numbers and times go on
    where the pass before ended. Every row makes its own repeats, so nothing is ordered or gathered."""
    length = rows.groupBy(*keys).agg((F.max(frame) + 1).alias("_len"))
    out = join_on(rows, length, keys).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return out.withColumns({frame: F.col(frame) + F.col("_k") * F.col("_len"), t: F.col(t) + F.col("_k") * F.col("_len") / F.lit(fps)}).drop("_k", "_len")


def mark_late(df: DataFrame, arrived: str, event: str, tolerance_s: float) -> DataFrame:
    """Flag rows that came later than the tolerance, and rows from the future, which no step may use as evidence.

    Done before any stateful step, whose watermark would drop late rows without a trace.
    """
    lateness = F.unix_micros(F.col(arrived)) / 1e6 - F.unix_micros(F.col(event)) / 1e6
    return df.withColumn("lateness_s", lateness).withColumns({
        "is_late": F.col("lateness_s") > tolerance_s, "is_future": F.col("lateness_s") < 0})


def telemetry(df: DataFrame, event: str, by: list[str], every: str = "1 minute", delay: str | None = None) -> DataFrame:
    """Calls, rows and mean and peak depth per window; expects ``fired`` and ``depth``."""
    if delay:
        df = df.withWatermark(event, delay)
    return df.groupBy(F.window(event, every).alias("w"), *by).agg(
        F.count("*").alias("rows"), F.count_if("fired").alias("calls"), F.avg("depth").alias("mean_depth"),
        F.max("depth").alias("peak_depth"),
    ).select(F.col("w.start").alias("window_start"), *by, "rows", "calls", "mean_depth", "peak_depth")


def answered_once(df: DataFrame, event: str, delay: str, query_id: str = "query_id") -> DataFrame:
    return df.withWatermark(event, delay).dropDuplicatesWithinWatermark([query_id])


def thin_batches(df: DataFrame, by: list[str], order: list[str], keep: int, newest: bool, kept_path: str,
                 dropped_path: str, checkpoint: str) -> StreamingQuery:
    """Per micro-batch: write the rows a backlog keeps and, apart, those it drops with the reason.

    The batch number is in the folder name, so a repeated batch overwrites itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        marked = thin(batch, by, order, keep, newest).persist()
        try:
            marked.filter("kept").drop("kept", "reason").write.mode("overwrite").parquet(f"{kept_path}/batch={batch_id}")
            marked.filter("not kept").drop("kept").write.mode("overwrite").parquet(f"{dropped_path}/batch={batch_id}")
        finally:
            marked.unpersist()

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available, write it, and read the result back as a table."""
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start(path)
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
