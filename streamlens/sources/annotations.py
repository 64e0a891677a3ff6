"""Annotation documents: JSON per stream with its events and the state of every row.

A long stream may be split over several documents of the same name; ``first_frame`` then says where
each one starts (absent = 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "struct<t_start:double,kind:string,semantic:boolean,description:string>"
SCHEMA = (
    f"name string, path string, fps double, n_frames int, duration_s double, events array<{EVENT}>,"
    " state_ids array<int>, purpose string, schema_version int, first_frame bigint"
)


def read(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """A folder of documents. ``multi_line``: one document per file; else one per line."""
    return spark.read.schema(SCHEMA).option("multiLine", multi_line).json(folder)


def _first() -> Column:
    return F.coalesce(F.col("first_frame"), F.lit(0).cast("long"))


def states(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("name").alias("stream_id"), _first().alias("_f"), F.posexplode("state_ids").alias("_i", "state_id"))
    return rows.select("stream_id", (F.col("_f") + F.col("_i")).alias("frame_idx"), "state_id")


def events(docs: DataFrame, semantic_only: bool = False) -> DataFrame:
    rows = docs.select(F.col("name").alias("stream_id"), F.inline("events"))
    return rows.filter("semantic") if semantic_only else rows


def inventory(docs: DataFrame) -> DataFrame:
    """Frames, events, semantic events and distinct states of each stream."""
    per_doc = docs.select(
        "name", F.size("state_ids").alias("f"), F.size("events").alias("e"),
        F.size(F.filter("events", lambda e: e["semantic"])).alias("s"))
    sums = per_doc.groupBy("name").agg(F.sum("f").alias("n_frames"), F.sum("e").alias("n_events"), F.sum("s").alias("n_semantic"))
    distinct = docs.select("name", F.explode(F.array_distinct("state_ids")).alias("x")).groupBy("name").agg(
        F.countDistinct("x").alias("n_states"))
    return sums.join(distinct, "name", "left").withColumnRenamed("name", "stream_id")


def state_at(docs: DataFrame, indices: list[int]) -> DataFrame:
    """State of each stream at the given rows, an index out of range held to the first or last row."""
    n = docs.groupBy("name").agg(F.sum(F.size("state_ids")).alias("_n"))
    probe = docs.join(n, "name").withColumn("i", F.explode(F.array(*[F.lit(i) for i in indices])))
    at = F.least(F.greatest(F.col("i").cast("long"), F.lit(0)), F.col("_n") - 1) - _first()
    here = probe.withColumn("_at", at).filter((F.col("_at") >= 0) & (F.col("_at") < F.size("state_ids")))
    return here.select(F.col("name").alias("stream_id"), "i", F.col("state_ids")[F.col("_at").cast("int")].alias("state_id"))
