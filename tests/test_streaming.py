import numpy as np
import pytest
from helpers import TRACE, random_rows, trace
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlens.operators.policies import AdaptiveQuantile, FixedInterval, InformationGain, Trigger, make_policy
from streamlens.operators.triggers import decisions
from streamlens.streaming import state, windows

POLICIES = [FixedInterval(0.5), make_policy("embedding_novelty", 0.9), InformationGain(0.3), AdaptiveQuantile(0.9, 2.0, 0.3, 10)]
DDL = TRACE + ", ts timestamp"


def pieces(spark, tmp_path, rows, cuts):
    """Write rows as one file per piece; the modification times follow the order of the pieces."""
    folder = str(tmp_path / "in")
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        spark.createDataFrame(rows[lo:hi], TRACE).withColumn("ts", F.timestamp_micros(((F.col("t") + 1e6) * 1e6).cast("long"))).coalesce(1).write.mode("append").parquet(folder)
    return folder, T._parse_datatype_string(DDL)


def key(d):
    return sorted((r.stream_id, r.policy, r.point, r.frame_idx) for r in d.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_in_any_batch_sizes(spark, tmp_path, seed):
    rows = sorted(random_rows("a", 150, seed) + random_rows("b", 150, seed + 10), key=lambda r: r[1])
    cuts = [0, *sorted(np.random.default_rng(seed).choice(range(1, 300), 2, replace=False).tolist()), 300]
    folder, schema = pieces(spark, tmp_path, rows, cuts)
    stream = windows.replay_source(spark, folder, schema)
    out = state.stream_fold(stream, Trigger(POLICIES), ["stream_id"], ["frame_idx"])
    got = windows.run_to_parquet(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert key(got) == key(decisions(trace(spark, rows), POLICIES))


def test_rows_out_of_order_wait_for_the_watermark(spark, tmp_path):
    rows = random_rows("a", 120, 5)
    shuffled = [rows[i] for i in np.random.default_rng(0).permutation(120)]
    end = ("end", 0, 1000.0, 0.0, 0.0, 0.0, 0, "")
    folder, schema = pieces(spark, tmp_path, shuffled + [end], [0, 60, 120, 121])
    stream = windows.replay_source(spark, folder, schema).withWatermark("ts", "10 seconds")
    out = state.stream_fold(stream, Trigger(POLICIES), ["stream_id"], ["frame_idx"], hold="ts")
    got = windows.run_to_parquet(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert key(got) == key(decisions(trace(spark, rows), POLICIES))


def test_late_and_future_rows(spark):
    df = spark.createDataFrame([(1, 10_000_000, 10_500_000), (2, 10_000_000, 13_000_000), (3, 10_000_000, 9_000_000)], "id int, e long, a long").select(
        "id", F.timestamp_micros("e").alias("ts"), F.timestamp_micros("a").alias("arrived"))
    d = {r.id: (r.is_late, r.is_future) for r in windows.mark_late(df, "arrived", "ts", 1.0).collect()}
    assert d == {1: (False, False), 2: (True, False), 3: (False, True)}
