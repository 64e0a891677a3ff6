"""Sources and sinks: files are written from the test tables into a fresh folder, then scanned."""

from pyspark.sql import functions as F

from streamlens.operators.layout import lay_out
from streamlens.operators.quantiles import percentile_block
from streamlens.operators.telemetry import answer_staleness, call_latencies, energy, memory
from streamlens.plans.aggregate_queries import RUNS, run_rates
from streamlens.plans.join_queries import CALLS
from streamlens.plans.registry import EV, TR, query, r
from streamlens.plans.scalar import annotation_docs, rd
from streamlens.plans.signal_queries import MOVES
from streamlens.session import shared_path
from streamlens.sources import annotations, builds, documents, inventory, questions, tables, traces
from streamlens.sources.tables import table


def scratch(spark, name):
    """A new folder below the shared checkpoint folder, readable by every executor; it goes with the application."""
    return shared_path(spark, name)


def written_annotations(spark, path):
    folder = scratch(spark, "annotations")
    annotation_docs(spark, path).write.json(folder)
    return annotations.read(spark, folder, multi_line=False)


@query("a1_annotation_states", f"WITH {TR} SELECT CAST(stream_id AS VARCHAR) AS stream_id, frame_idx, state_id FROM tr")
def a1_states(spark, path):
    return annotations.states(written_annotations(spark, path))


@query("a1_annotation_events", f"WITH {TR}, {MOVES} SELECT CAST(stream_id AS VARCHAR) AS stream_id, {r('frame_idx / 30.0::DOUBLE', 't_start')}, 'state_change' AS kind, motion >= 0.1 AS semantic, answer AS description FROM mv")
def a1_events(spark, path):
    e = annotations.events(written_annotations(spark, path))
    return e.withColumn("t_start", F.round("t_start", 6))


@query("a2_trace_store", f"WITH {TR} SELECT stream_id, frame_idx, {r('novelty', 'novelty')}, {r('motion', 'motion')}, state_id, answer FROM tr")
def a2(spark, path):
    folder = scratch(spark, "trace")
    traces.save(tables.trace(spark, path).result(), folder)
    return traces.load(spark, folder).select("stream_id", "frame_idx", rd(F.col("novelty"), "novelty"), rd(F.col("motion"), "motion"), "state_id", "answer")


@query("a2_trace_arrays", f"WITH {TR} SELECT stream_id, frame_idx, {r('frame_idx / 30.0::DOUBLE', 't')}, {r('novelty', 'novelty')}, state_id, answer FROM tr")
def a2_arrays(spark, path):
    folder = scratch(spark, "trace-arrays")
    traces.to_arrays(tables.trace(spark, path).result(), 30.0).write.parquet(folder)
    rows = traces.from_arrays(spark.read.parquet(folder))
    return rows.select("stream_id", "frame_idx", rd(F.col("t"), "t"), rd(F.col("novelty"), "novelty"), "state_id", "answer")


@query("a3_question_scan", """SELECT 'sample_' || (doc_id % 50) || '_' || doc_id AS question_id, doc_id % 50 AS sample, doc_id AS index, source AS task_type, md5(text) AS question, (doc_id % 3600)::DOUBLE AS t, chr(CAST(65 + doc_id % 4 AS INTEGER)) AS answer, ['A. ' || lang, 'B. it''s "no"'] AS options
FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0""")
def a3(spark, path):
    i = F.col("doc_id")
    stamp = F.format_string("%02d:%02d:%02d", F.lit(0), F.floor(i % 3600 / 60).cast("int"), (i % 60).cast("int"))
    options = F.when(i % 13 == 0, F.lit("['A. broken")).otherwise(F.concat(F.lit("['A. "), F.col("lang"), F.lit("""', "B. it's \\"no\\""]""")))
    qid = F.when(i % 11 == 0, F.concat(F.lit("bad_"), i)).otherwise(F.concat(F.lit("sample_"), i % 50, F.lit("_"), i))
    rows = table(spark, path, "documents").select(
        qid.alias("question_id"), F.col("source").alias("task_type"), F.col("text").alias("question"), stamp.alias("time_stamp"),
        F.concat(F.lit(" "), F.lower(F.chr(65 + i % 4)), F.lit(" ")).alias("answer"), options.alias("options"), F.lit("").alias("frames_required"), F.lit("x").alias("temporal_clue_type"))
    folder = scratch(spark, "questions")
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return questions.read(spark, folder).select("question_id", "sample", "index", "task_type", F.md5("question").alias("question"), "t", "answer", "options")


def run_documents(spark, path):
    """A metrics document per run, from the run's own frames, calls and answers."""
    fr, calls, answers = tables.call_log(spark, path)
    rates = run_rates(spark, path)
    lat = call_latencies(calls, fr, ["run_id"])
    out, within = rates, tables.events_laid(spark, path)
    for name, df, col in (("photon_to_first_token_ms", lat, "first_token_ms"), ("photon_to_answer_ms", lat, "answer_ms"),
                          ("answer_staleness_ms", answer_staleness(answers, fr, ["run_id"]), "staleness_ms")):
        b = percentile_block(df, ["run_id"], col, within=within)
        out = out.join(b.select("run_id", F.struct("n", "mean", "p50", "p95", "p99", "min", "max", "std").alias(name)), "run_id", "left")
    stages = percentile_block(tables.events(spark, path).select(F.col("stream_id").alias("run_id"), F.col("event_type").alias("stage"), "value"), ["run_id", "stage"], "value", within=within)
    packed = stages.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "stage", F.struct("n", "mean", "p50", "p95", "p99", "min", "max", "std")))).alias("stages_ms"))  # one entry per stage name
    e = tables.events(spark, path).withColumnRenamed("stream_id", "run_id")
    depth = documents.depth_blocks(
        lay_out(e.select("run_id", F.col("event_type").alias("queue"), "t", "t_us", "event_id", F.floor(F.col("value") / 10).cast("int").alias("depth")), ["run_id", "queue"], ["t_us", "event_id"]),
        "run_id", "queue")
    power = tables.power_samples(spark, path)
    watts = energy(power).select(F.col("stream_id").alias("run_id"), F.struct("mean_w", "peak_w", "energy_j").alias("power"))
    vram = memory(power.result(), ["stream_id"]).select(F.col("stream_id").alias("run_id"), F.struct("peak_used_gb", "mean_used_gb").alias("vram"))
    counts = e.groupBy("run_id", "event_type").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"))
    for more in (packed, depth, watts, vram, counts):
        out = out.join(more, "run_id", "left")
    run = F.col("run_id")
    out = out.withColumns({
        "name": run.cast("string"), "status": F.when(run % 10 == 0, "failed").when(run % 7 == 0, "paused").otherwise("completed"),
        "duration_requested_s": F.when(run % 13 != 0, F.col("duration_s")), "duration_actual_s": F.col("duration_s"), "t_start_monotonic": F.lit(0.0),
        "started_utc": F.lit("2024-01-01T00:00:00Z"), "trigger_count": F.col("calls")})
    out = out.withColumnsRenamed({"captured": "frames_captured", "dropped": "frames_dropped", "calls": "vlm_calls", "calls_per_min": "vlm_calls_per_min"})
    machine = F.struct(F.lit("3").alias("python"), F.lit("linux").alias("platform"), F.when(run % 11 != 0, "none").alias("gpu_name"), run.cast("long").alias("seed"))
    return documents.build(out, ["name", "status", "duration_requested_s", "duration_actual_s", "t_start_monotonic", "started_utc"],
                           machine, F.create_map(F.lit("policy"), F.lit("novelty")), F.col("counts"), F.coalesce("truncated", F.lit(False)))


def written_documents(spark, path, status=None):
    folder = scratch(spark, "documents")
    documents.write(run_documents(spark, path), folder)
    return documents.read(spark, folder, multi_line=False, status=status)


@query("a4_document_scan", f"""WITH {RUNS} SELECT CAST(run_id AS VARCHAR) AS run_id, 'completed' AS status, captured AS frames_captured, dropped AS frames_dropped, {r('drop_rate', 'drop_rate')}, calls AS vlm_calls FROM rr WHERE run_id % 10 <> 0 AND run_id % 7 <> 0""")
def a4(spark, path):
    m = documents.metrics_of(written_documents(spark, path, "completed"))
    return m.select("run_id", "status", "frames_captured", "frames_dropped", rd(F.col("drop_rate"), "drop_rate"), "vlm_calls")


@query("a4_stage_rows", f"WITH {EV} SELECT CAST(stream_id AS VARCHAR) AS run_id, event_type AS stage, count(*) AS n, {r('quantile_cont(value, 0.95)', 'p95')} FROM ev GROUP BY ALL")
def a4_stages(spark, path):
    return documents.stage_rows(written_documents(spark, path)).select("run_id", "stage", "n", rd(F.col("p95"), "p95"))


@query("a5_document_sink", f"""WITH {CALLS} SELECT CAST(run_id AS VARCHAR) AS run_id, count(*) AS n, {r('quantile_cont(answer_ms, 0.5)', 'p50', 2)}, {r('max(answer_ms)', 'max', 2)} FROM lat GROUP BY 1""")
def a5(spark, path):
    m = documents.metrics_of(written_documents(spark, path)).filter("photon_to_answer_ms is not null")
    b = F.col("photon_to_answer_ms")
    return m.select("run_id", b["n"].alias("n"), rd(b["p50"], "p50", 2), rd(b["max"], "max", 2))


@query("a5_document_parts", f"""WITH {EV}, x AS (SELECT stream_id, t, t_us, event_id, event_type, value, lag(t) OVER w AS pt, lag(value) OVER w AS pv FROM ev WINDOW w AS (PARTITION BY stream_id ORDER BY t_us, event_id)),
c AS (SELECT stream_id, count(*) AS n, CAST(max(floor(value / 10)) AS BIGINT) AS d, sum(floor(value / 10)) AS s, count(*) FILTER (event_type = 'click') AS k FROM ev WHERE event_type = 'click' GROUP BY 1),
m AS (SELECT stream_id, max(n) AS most FROM (SELECT stream_id, event_type, count(*) AS n FROM ev GROUP BY ALL) GROUP BY 1)
SELECT CAST(x.stream_id AS VARCHAR) AS run_id, {r('avg(value)', 'mean_w', 4)}, {r('sum((t - pt) * (value + pv) / 2.0::DOUBLE)', 'energy_j', 1)}, {r('max(CAST(value * 10000000 AS BIGINT)) / 1073741824.0::DOUBLE', 'peak_used_gb', 5)},
 any_value(c.d) AS click_depth, CAST(any_value(c.n) AS INTEGER) AS click_points, any_value(c.s)::DOUBLE AS click_sum, any_value(c.k) AS clicks, any_value(m.most) > {documents.DEPTH_POINTS} AS truncated, 0 AS n_missing
FROM x JOIN m ON m.stream_id = x.stream_id LEFT JOIN c ON c.stream_id = x.stream_id GROUP BY x.stream_id HAVING count(*) > 1""")
def a5_parts(spark, path):
    folder = scratch(spark, "documents")
    documents.write(run_documents(spark, path), folder)
    d = documents.read(spark, folder, multi_line=False)
    missing = documents.missing_keys(spark.read.text(folder)).groupBy("run_id").agg(F.count("*").cast("int").alias("n_missing"))
    q = F.col("metrics.queue_depth")["click"]
    out = d.select(F.col("run.name").alias("run_id"), rd(F.col("metrics.power.mean_w"), "mean_w", 4), rd(F.col("metrics.power.energy_j"), "energy_j", 1),
                   rd(F.col("metrics.vram.peak_used_gb"), "peak_used_gb", 5), q["max"].alias("click_depth"), F.when(q.isNotNull(), F.size(q["series"])).alias("click_points"),
                   F.aggregate(q["series"], F.lit(0.0), lambda a, p: a + p[1]).alias("click_sum"),
                   F.col("events.counts")["click"].alias("clicks"), F.col("events.truncated").alias("truncated")).filter("mean_w is not null")
    return out.join(missing, "run_id", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))


@query("a6_document_validator", f"""WITH {EV}, r AS (SELECT DISTINCT stream_id AS i FROM ev)
SELECT CAST(i AS VARCHAR) AS run_id, 'run.status unknown' AS rule FROM r WHERE i % 10 <> 0 AND i % 7 = 0
UNION ALL SELECT CAST(i AS VARCHAR), 'run.duration_requested_s not numeric' FROM r WHERE i % 13 = 0
UNION ALL SELECT CAST(i AS VARCHAR), 'environment.gpu_name missing' FROM r WHERE i % 11 = 0""")
def a6(spark, path):
    return documents.violations(written_documents(spark, path))


@query("a7_file_inventory", """WITH o AS (SELECT custkey, key, total FROM (SELECT o_custkey AS custkey, o_orderkey AS key, CAST(floor(o_totalprice) AS BIGINT) AS total FROM orders)),
f AS (SELECT custkey AS sample, CASE WHEN key % 6 = 0 THEN '/data/__MACOSX/sample_' || custkey || '/._v' || key || '.mp4' WHEN key % 6 = 1 THEN '/data/sample_' || custkey || '/notes' || key || '.txt' ELSE '/data/sample_' || custkey || '/v' || key || '.MKV' END AS path, total AS length, key FROM o WHERE key IS NOT NULL),
x AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY length DESC, path) AS rn FROM f WHERE key % 6 > 1 AND length > 100000) SELECT sample, path, length FROM x WHERE rn = 1""")
def a7(spark, path):
    o = table(spark, path, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("long").alias("length"))
    c, k = F.col("c"), F.col("k")
    name = (
        F.when(k % 6 == 0, F.concat(F.lit("/data/__MACOSX/sample_"), c, F.lit("/._v"), k, F.lit(".mp4")))
        .when(k % 6 == 1, F.concat(F.lit("/data/sample_"), c, F.lit("/notes"), k, F.lit(".txt")))
        .otherwise(F.concat(F.lit("/data/sample_"), c, F.lit("/v"), k, F.lit(".MKV"))))
    return inventory.largest_video(o.select(name.alias("path"), "length")).select("sample", "path", "length")


@query("a9_signal_backfill", f"WITH {TR} SELECT stream_id, frame_idx, {r('CASE WHEN motion > 0.05 THEN novelty * 2 END', 'novelty')}, {r('motion', 'motion')} FROM tr")
def a9(spark, path):
    tr = tables.trace(spark, path).result()
    new = tr.filter("motion > 0.05").select("stream_id", "frame_idx", (F.col("novelty") * 2).alias("novelty"))
    return traces.backfill(tr, new, ["novelty"]).select("stream_id", "frame_idx", rd(F.col("novelty"), "novelty"), rd(F.col("motion"), "motion"))


@query("a10_incremental_build", f"WITH {TR} SELECT stream_id, count(*) AS n FROM tr WHERE stream_id NOT IN (SELECT stream_id FROM tr WHERE novelty > 0.8) GROUP BY 1")
def a10(spark, path):
    tr = tables.trace(spark, path).result()
    todo = traces.missing(tr.select("stream_id").distinct(), tr.filter("novelty > 0.8"))
    return tr.join(todo, "stream_id", "left_semi").groupBy("stream_id").agg(F.count("*").alias("n"))


@query("a10_changed_inputs", f"""WITH {TR}, hot AS (SELECT DISTINCT stream_id FROM tr WHERE novelty > 0.5), x AS (SELECT tr.*, hot.stream_id IS NOT NULL AS h FROM tr LEFT JOIN hot USING (stream_id))
SELECT stream_id, CASE WHEN h THEN 2 ELSE 1 END AS version, count(*) AS n, {r('sum(novelty * CASE WHEN h THEN 20 ELSE 10 END)', 'score', 4)} FROM x GROUP BY stream_id, h""")
def a10_changed(spark, path):
    """All streams are built; then some streams' input changes, and only these are built again."""
    tr = tables.trace(spark, path).result().select("stream_id", "frame_idx", "novelty")
    hot = tr.filter("novelty > 0.5").select("stream_id", F.lit(2.0).alias("_by")).distinct()
    changed = tr.join(hot, "stream_id", "left").withColumn("novelty", F.col("novelty") * F.coalesce("_by", F.lit(1.0))).drop("_by")
    folder = scratch(spark, "build")

    def score(rows):
        return rows.select("stream_id", "frame_idx", (F.col("novelty") * 10).alias("score"))

    for rows in (tr, changed):
        builds.build(rows, folder, score)
    return builds.load(spark, folder).groupBy("stream_id", "version").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))
