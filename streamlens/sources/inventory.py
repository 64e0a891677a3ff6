"""Which file holds each sample's video: names and sizes only, contents are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlens.operators.scoring import rank_first

SUFFIXES = ("mp4", "mkv", "webm", "avi")


def scan(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def largest_video(files: DataFrame, min_bytes: int = 100_000) -> DataFrame:
    """Largest real video per sample; resource-fork stubs, other suffixes and tiny files are skipped."""
    name = F.element_at(F.split("path", "/"), -1)
    sample = F.regexp_extract("path", r"/sample_(\d+)/[^/]*$", 1)
    ok = (
        F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*SUFFIXES)
        & ~name.startswith("._") & ~F.col("path").contains("/__MACOSX/")
        & (F.col("length") > min_bytes) & (sample != "")
    )
    rows = files.filter(ok).withColumn("sample", sample.cast("long"))
    return rank_first(rows, ["sample"], [F.col("length").desc(), F.col("path")])
