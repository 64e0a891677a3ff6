import pytest
from pyspark.sql import functions as F

from streamlens.session import shared_path
from streamlens.sources import builds

DDL = "stream_id string, i long, v double"
ROWS = [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0), ("c", 0, None), (None, 0, 5.0)]


def doubled(rows):
    return rows.select("stream_id", "i", (F.col("v") * 2).alias("w"))


def held(spark, path, **which):
    return {(r.stream_id, r.i): (r.w, r.version) for r in builds.load(spark, path, **which).collect()}


def states(df):
    return {r.stream_id: r.state for r in df.collect()}


def test_only_what_changed_is_built_again(spark):
    path = shared_path(spark, "builds")
    got = builds.build(spark.createDataFrame(ROWS, DDL), path, doubled)
    assert states(got) == {"a": "new", "b": "new", "c": "new", None: "new"}
    first = held(spark, path)
    assert first == {("a", 0): (2.0, 1), ("a", 1): (4.0, 1), ("b", 0): (6.0, 1), ("c", 0): (None, 1), (None, 0): (10.0, 1)}

    asked = []
    later = [("a", 1, 2.0), ("a", 0, 1.0), ("c", 0, 7.0), ("d", 0, 8.0), (None, 0, 5.0)]  # a: other order; b: gone

    def noted(rows):
        asked.extend(r.stream_id for r in rows.collect())
        return doubled(rows)

    got = builds.build(spark.createDataFrame(later, DDL), path, noted)
    assert states(got) == {"a": "same", "b": "gone", "c": "changed", "d": "new", None: "same"}
    assert sorted(asked) == ["c", "d"]
    assert held(spark, path) == {("a", 0): (2.0, 1), ("a", 1): (4.0, 1), ("c", 0): (14.0, 2), ("d", 0): (16.0, 2), (None, 0): (10.0, 1)}
    assert held(spark, path, version=1) == first

    got = builds.build(spark.createDataFrame(later, DDL), path, noted)
    assert set(states(got).values()) == {"same"} and builds.versions(spark, path) == [1, 2] and len(asked) == 2
    got = builds.build(spark.createDataFrame(later, DDL), path, doubled, recipe="second")
    assert set(states(got).values()) == {"changed"} and builds.versions(spark, path) == [1, 2, 3]


def test_a_failed_build_leaves_the_version_before(spark):
    path = shared_path(spark, "builds-failed")
    builds.build(spark.createDataFrame(ROWS, DDL), path, doubled)
    first = held(spark, path)
    changed = spark.createDataFrame([(k, i, 9.0) for k, i, _ in ROWS], DDL)

    def broken(rows):
        # some rows are written before one fails
        return doubled(rows).withColumn("w", F.when(F.col("stream_id") == "b", F.raise_error(F.lit("no answer")).cast("double")).otherwise(F.col("w")))

    with pytest.raises(Exception, match="no answer"):
        builds.build(changed, path, broken)
    assert builds.versions(spark, path) == [1] and held(spark, path) == first
    builds.build(changed, path, doubled)
    assert set(held(spark, path).values()) == {(18.0, 2)}


def test_fingerprints_see_repeats_nulls_and_columns(spark):
    def of(rows, ddl=DDL):
        return builds.fingerprints(spark.createDataFrame(rows, ddl)).first().fingerprint

    base = of([("a", 0, 1.0)])
    others = [of([("a", 0, 1.0)] * 2), of([("a", None, 1.0)]), of([("a", 0, None)]), of([("a", 1, 0.0)]), of([("a", 0, 1.0)], "stream_id string, i long, x double")]
    assert len({base, *others}) == 6 and base == of([("a", 0, 1.0)])


def test_empty_input(spark):
    path = shared_path(spark, "builds-empty")
    with pytest.raises(FileNotFoundError):
        builds.load(spark, path)
    assert builds.build(spark.createDataFrame([], DDL), path, doubled).count() == 0
    assert builds.versions(spark, path) == [1] and builds.load(spark, path).count() == 0
