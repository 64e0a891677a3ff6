"""Metrics documents: one nested JSON per run, read, written and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlens.operators import telemetry
from streamlens.operators.layout import Laid, join_on

VERSION = 1
# The status a run may have, its latency blocks and the keys a document must carry.
STATUSES = ("completed", "interrupted", "failed")
BLOCKS = ("photon_to_first_token_ms", "photon_to_answer_ms", "answer_staleness_ms", "capture_interval_ms")

TOP_KEYS = ("schema_version", "run", "environment", "config", "definitions", "metrics", "events")
METRIC_KEYS = (
    "frames_captured", "frames_dropped", "drop_rate", "achieved_fps", "capture_interval_ms", "stages_ms", "queue_depth",
    "photon_to_first_token_ms", "photon_to_answer_ms", "vlm_calls", "vlm_calls_per_min", "answer_staleness_ms",
    "accuracy_vs_oracle", "false_trigger_rate", "trigger_count", "power", "vram")
ENVIRONMENT_KEYS = ("python", "platform", "gpu_name", "seed")

BLOCK = "struct<n:bigint,mean:double,p50:double,p95:double,p99:double,min:double,max:double,std:double>"
DEPTH = "struct<max:bigint,mean:double,n_samples:bigint,series:array<array<double>>>"
SCHEMA = f"""
schema_version int,
run struct<name:string,status:string,duration_requested_s:double,duration_actual_s:double,t_start_monotonic:double,started_utc:string>,
environment struct<python:string,platform:string,gpu_name:string,seed:bigint>,
config map<string,string>,
definitions map<string,string>,
metrics struct<frames_captured:bigint,frames_dropped:bigint,drop_rate:double,achieved_fps:double,vlm_calls:bigint,
  vlm_calls_per_min:double,{",".join(f"{b}:{BLOCK}" for b in BLOCKS)},stages_ms:map<string,{BLOCK}>,queue_depth:map<string,{DEPTH}>,
  accuracy_vs_oracle:double,false_trigger_rate:double,trigger_count:bigint,
  power:struct<mean_w:double,peak_w:double,energy_j:double>,vram:struct<peak_used_gb:double,mean_used_gb:double>>,
events struct<counts:map<string,bigint>,truncated:boolean>
"""


def read(spark: SparkSession, path: str, multi_line: bool = True, status: str | None = None) -> DataFrame:
    docs = spark.read.schema(SCHEMA).option("multiLine", multi_line).json(path)
    return docs.filter(F.col("run.status") == status) if status else docs


def metrics_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("run.name").alias("run_id"), F.col("run.status").alias("status"), "metrics.*").drop("stages_ms", "queue_depth")


def stage_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("run.name").alias("run_id"), F.explode("metrics.stages_ms").alias("stage", "b")).select("run_id", "stage", "b.*")


def depth_series(docs: DataFrame) -> DataFrame:
    q = docs.select(F.col("run.name").alias("run_id"), F.col("run.t_start_monotonic").alias("t0"),
                    F.explode("metrics.queue_depth").alias("queue", "q"))
    p = q.select("run_id", "queue", "t0", F.explode("q.series").alias("p"))
    t = F.col("p")[0]
    return p.select("run_id", "queue", t.alias("t"), (t - F.coalesce("t0", F.lit(0.0))).alias("t_rel"), F.col("p")[1].cast("int").alias("depth"))


def write(runs: DataFrame, path: str) -> None:
    """One document per line; what is unknown is there as null. Raw events stay in their own tables: a document holds
    aggregates, and of every queue a bounded series."""
    runs.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


#: Fixed value: points of a queue's series that a document holds at most. ``events.truncated`` says whether some run has more;
#: those lie in ``overflow_points``, so document and overflow together hold the whole series.
DEPTH_POINTS = 500_000


def depth_blocks(samples: Laid, run: str, queue: str, t: str = "t", depth: str = "depth", points: int = DEPTH_POINTS) -> DataFrame:
    """(run, queue_depth, truncated): the map of a run's queues to maximum, mean, number of samples and first ``points`` points."""
    keys = [run, queue]
    series = telemetry.depth_points(samples, t, depth).filter(F.col("point") < points).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("point", "t_rel", F.col(depth).cast("double").alias("d")))).alias("_s"))
    both = join_on(telemetry.queue_depth(samples.result().withColumnRenamed(depth, "depth"), keys), series, keys)
    block = F.struct(
        F.col("max_depth").cast("long").alias("max"), F.col("mean_depth").alias("mean"), F.col("n_samples"),
        F.transform("_s", lambda x: F.array(x["t_rel"], x["d"])).alias("series"))
    return both.groupBy(run).agg(
        F.map_from_entries(F.collect_list(F.struct(queue, block))).alias("queue_depth"), F.max(F.col("n_samples") > points).alias("truncated"))


def overflow_points(samples: Laid, t: str = "t", depth: str = "depth", points: int = DEPTH_POINTS) -> DataFrame:
    """The points of every queue that its document has no room for: keys, point, t_rel, depth. A table beside the documents."""
    return telemetry.depth_points(samples, t, depth).filter(F.col("point") >= points)


def write_valid(runs: DataFrame, path: str) -> None:
    """``write``, but of documents that break no rule: one that does fails the write, and its task commits nothing."""
    broken = F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules().items()]), lambda x: x.isNotNull()), ", ")
    text = F.concat(F.lit("metrics document of run "), F.coalesce("run.name", F.lit("?")), F.lit(" breaks: "), broken)
    write(runs.withColumn("schema_version", F.when(F.length(broken) > 0, F.raise_error(text).cast("int")).otherwise(F.col("schema_version"))), path)


def build(metrics: DataFrame, run: list[str], environment: Column, config: Column, counts: Column, truncated: Column) -> DataFrame:
    """Nest flat per-run columns into the document layout. A metric that ``metrics`` has no column for is null; the
    environment (a struct of ENVIRONMENT_KEYS), configuration and event counts are what the caller knows, nothing is made up."""
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(SCHEMA)["metrics"].dataType.fields}
    fields = [(F.col(k) if k in metrics.columns else F.lit(None)).cast(kinds[k]).alias(k) for k in METRIC_KEYS]
    return metrics.select(
        F.lit(VERSION).alias("schema_version"), F.struct(*run).alias("run"), environment.alias("environment"), config.alias("config"),
        F.create_map(F.lit("t0"), F.lit("frame capture")).alias("definitions"), F.struct(*fields).alias("metrics"),
        F.struct(counts.alias("counts"), truncated.alias("truncated")).alias("events"))


def rules() -> dict[str, Column]:
    """Rule name -> condition that is TRUE when the document breaks it."""
    out: dict[str, Column] = {
        "schema_version": ~F.col("schema_version").eqNullSafe(F.lit(VERSION)),
        "run.name missing": F.col("run.name").isNull(),
        "run.started_utc missing": F.col("run.started_utc").isNull(),
        "run.status unknown": ~F.coalesce(F.col("run.status").isin(*STATUSES), F.lit(False)),
        "run.duration_actual_s not numeric": F.col("run.duration_actual_s").isNull(),
        "definitions.t0 missing": F.col("definitions")["t0"].isNull(),
        "metrics missing": F.col("metrics").isNull(),
        "run.duration_requested_s not numeric": F.col("run.duration_requested_s").isNull(),
        **{f"environment.{k} missing": F.col(f"environment.{k}").isNull() for k in ENVIRONMENT_KEYS},
    }
    for b in BLOCKS:
        block = F.col(f"metrics.{b}")
        parts = [F.col(f"metrics.{b}.{k}") for k in ("n", "mean", "p50", "p95", "p99", "min", "max")]
        broken = parts[0].isNull()
        for p in parts[1:]:
            broken = broken | p.isNull()
        out[f"{b} incomplete"] = block.isNotNull() & broken
        out[f"{b} empty"] = F.coalesce(parts[0] == 0, F.lit(False))
    return out


def violations(docs: DataFrame, strict: bool = False) -> DataFrame:
    """One row per broken rule of a document; ``strict`` fails the job on the first."""
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules().items()]), lambda x: x.isNotNull())
    rows = docs.select(F.col("run.name").alias("run_id"), F.explode(found).alias("rule"))
    if strict:
        rows = rows.withColumn("rule", F.raise_error(F.concat(F.lit("bad metrics document: "), "rule")).cast("string"))
    return rows


def missing_keys(lines: DataFrame, text: str = "value") -> DataFrame:
    """Required keys absent from the raw document text (a key present with null is fine)."""
    def absent(required, have, where):
        gone = F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(have, F.array().cast("array<string>")))
        return F.transform(gone, lambda k: F.concat(F.lit(where), k))

    top = absent(TOP_KEYS, F.json_object_keys(F.col(text)), "")
    metric = absent(METRIC_KEYS, F.json_object_keys(F.get_json_object(F.col(text), "$.metrics")), "metrics.")
    run = F.get_json_object(F.col(text), "$.run.name")
    return lines.select(run.alias("run_id"), F.explode(F.concat(top, metric)).alias("missing"))
