"""Incremental builds: a table derived stream by stream, where only streams whose input changed are built again.

Under ``path`` lie ``data/build=N``, the rows that build N made, and ``manifest/build=N``, one row per stream with the
fingerprint of its input and the build that holds its rows. A build counts from the moment its manifest is complete
(Spark's ``_SUCCESS``), so one that fails or is cut off leaves the version before it readable, and a reader never sees half a
stream. One build at a time writes to a path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlens.operators.layout import join_on
from streamlens.session import stored


def fingerprints(rows: DataFrame, by: str = "stream_id", recipe: str = "") -> DataFrame:
    """(by, fingerprint): changes with any value of any row of the stream, the number of equal rows, the names and types of the
    columns and ``recipe`` (say, the builder's version), but not with the order of rows. One aggregate that combines before
    its shuffle."""
    columns = sorted(c for c in rows.columns if c != by)
    shape = ",".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    # a NULL leaves xxhash64 as it was, so which columns are NULL is hashed beside the values
    values = [F.col(f"`{c}`") for c in columns]
    row = F.xxhash64(*values, *[v.isNull() for v in values], F.lit(0))
    other = F.xxhash64(F.lit(1), *values, *[v.isNull() for v in values])
    parts = [F.count("*"), F.sum(row.cast("decimal(38,0)")), F.sum(other.cast("decimal(38,0)"))]
    return rows.groupBy(by).agg(F.sha2(F.concat_ws("/", F.lit(recipe), F.lit(shape), *[p.cast("string") for p in parts]), 256).alias("fingerprint"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete builds, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/build=*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(stream, fingerprint, version) of the newest complete build, or of the one named: which build holds a stream's rows."""
    known = versions(spark, path)
    version = version if version is not None else max(known, default=None)
    if version not in known:
        raise FileNotFoundError(f"no complete build {'' if version is None else version} under {path}")
    return spark.read.parquet(f"{path}/manifest/build={version}")


def changes(inputs: DataFrame, before: DataFrame | None, by: str = "stream_id", rebuild: bool = False) -> DataFrame:
    """(by, fingerprint, version, state) of every stream of ``inputs`` (see ``fingerprints``) or ``before`` (see ``manifest``):
    state is new, changed, same or gone; ``rebuild`` calls what is the same changed."""
    if before is None:
        return inputs.withColumns({"version": F.lit(None).cast("int"), "state": F.lit("new")})
    old = before.select(F.col(by).alias("_by"), F.col("fingerprint").alias("_old"), "version")
    both = inputs.join(old, F.col(by).eqNullSafe(F.col("_by")), "full")
    state = (F.when(F.col("fingerprint").isNull(), "gone").when(F.col("_old").isNull(), "new")
             .when((F.col("fingerprint") != F.col("_old")) | F.lit(rebuild), "changed").otherwise("same"))
    return both.select(F.coalesce(by, "_by").alias(by), "fingerprint", "version", state.alias("state"))


def build(rows: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], by: str = "stream_id", recipe: str = "",
          rebuild: bool = False) -> DataFrame:
    """Bring the table under ``path`` up to date with ``rows``; returns ``changes`` as they were found.

    ``make`` gets the rows of new and changed streams, whole, and returns theirs with the column ``by``. Streams that are gone leave the
    newest version. Where nothing changed nothing is written. A NULL stream is one like any other.
    """
    spark = rows.sparkSession
    known = versions(spark, path)
    found = changes(fingerprints(rows, by, recipe), manifest(spark, path) if known else None, by, rebuild)
    found = stored(found, "build-changes")
    if known and found.where("state <> 'same'").isEmpty():
        return found
    number = max(known, default=0) + 1
    todo = found.where("state in ('new', 'changed')").select(by)
    make(join_on(rows, todo, [by], "left_semi")).write.mode("overwrite").parquet(f"{path}/data/build={number}")
    # last: from here on the build counts
    kept = found.where("state <> 'gone'").withColumn("version", F.when(F.col("state") == "same", F.col("version")).otherwise(number))
    kept.select(by, "fingerprint", "version").write.mode("overwrite").parquet(f"{path}/manifest/build={number}")
    return found


def load(spark: SparkSession, path: str, by: str = "stream_id", version: int | None = None) -> DataFrame:
    """Rows of the newest complete build, or of the one named, with the build that made them as ``version``. Only folders that its
    manifest names are read."""
    named = manifest(spark, path, version)
    folders = [r.version for r in named.select("version").distinct().collect()]  # as many as builds at most
    if not folders:
        folders = [max(versions(spark, path)) if version is None else version]
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/build={v}" for v in folders])
    return join_on(rows.withColumnRenamed("build", "version"), named.select(by, "version"), [by, "version"], "left_semi")
