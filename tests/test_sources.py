import json

import pytest
from helpers import trace, two_state_rows

from streamlens.operators.inference import answer_fired, chat_request
from streamlens.operators.layout import lay_out
from streamlens.sources import annotations, documents, inventory, questions, traces


def test_trace_round_trip_and_version_guard(spark, tmp_path):
    rows = trace(spark, two_state_rows(n=50)).df
    docs = traces.to_arrays(rows, 30.0, part_rows=20)
    assert docs.count() == 3
    back = traces.from_arrays(docs)
    assert sorted(map(tuple, back.select("frame_idx", "novelty", "answer").collect())) == sorted(map(tuple, rows.select("frame_idx", "novelty", "answer").collect()))
    with pytest.raises(Exception, match="version"):
        traces.from_arrays(docs.withColumn("schema_version", docs.schema_version + 1)).collect()
    traces.save(rows, str(tmp_path / "t"), by_stream=True)
    assert traces.load(spark, str(tmp_path / "t")).count() == 50


def test_signal_view_and_backfill(spark):
    rows = trace(spark, two_state_rows(n=4)).df
    assert traces.with_signal(rows, "motion").first().novelty == 0.002
    with pytest.raises(ValueError):
        traces.with_signal(rows, "nope")
    new = rows.filter("frame_idx < 2").selectExpr("stream_id", "frame_idx", "9.0D as novelty_patch")
    got = {r.frame_idx: r.novelty_patch for r in traces.backfill(rows, new, ["novelty_patch"]).collect()}
    assert got == {0: 9.0, 1: 9.0, 2: None, 3: None}


def test_annotations(spark, tmp_path):
    doc = {"name": "clip", "fps": 30.0, "n_frames": 3, "duration_s": 0.1, "state_ids": [0, 0, 1], "purpose": "", "schema_version": 1,
           "events": [{"t_start": 0.1, "kind": "cut", "semantic": True, "description": "d"}, {"t_start": 0.2, "kind": "light", "semantic": False, "description": ""}]}
    (tmp_path / "clip.json").write_text(json.dumps(doc, indent=2))
    docs = annotations.read(spark, str(tmp_path))
    assert [r.state_id for r in annotations.states(docs).orderBy("frame_idx").collect()] == [0, 0, 1]
    assert annotations.events(docs, semantic_only=True).count() == 1
    assert [r.state_id for r in annotations.state_at(docs, [-5, 1, 99]).orderBy("i").collect()] == [0, 0, 1]
    r = annotations.inventory(docs).first()
    assert (r.n_frames, r.n_events, r.n_semantic, r.n_states) == (3, 2, 1, 2)


def test_question_csv(spark, tmp_path):
    head = "question_id,task_type,question,time_stamp,answer,options,frames_required,temporal_clue_type\n"
    body = ('sample_3_7,Count,"How many, really?\nsay it",00:01:05, b ,"[\'A. one\', ""B. it\'s two""]",1,now\n'
            "nothing,Count,q,00:01,A,\"['A']\",1,now\nsample_4_1,Count,q,00:01,A,not a list,1,now\n")
    (tmp_path / "q.csv").write_text(head + body)
    r = questions.read(spark, str(tmp_path / "q.csv")).collect()
    assert len(r) == 1
    assert (r[0]["sample"], r[0]["index"], r[0].t, r[0].answer, r[0].options) == (3, 7, 65.0, "B", ["A. one", "B. it's two"])
    assert "\n" in r[0].question


def test_largest_video(spark, tmp_path):
    def put(path, n):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * n)

    put("sample_1/a.mp4", 200_001)
    put("sample_1/b.MKV", 300_000)
    put("sample_1/c.txt", 900_000)
    put("__MACOSX/sample_1/._b.mp4", 400_000)
    put("sample_2/small.mp4", 100)
    r = inventory.largest_video(inventory.scan(spark, str(tmp_path))).collect()
    assert [(x["sample"], x["length"]) for x in r] == [(1, 300_000)]


def test_documents_checked(spark, tmp_path):
    block = {"n": 1, "mean": 1.0, "p50": 1.0, "p95": 1.0, "p99": 1.0, "min": 1.0, "max": 1.0}
    good = {"schema_version": 1, "run": {"name": "ok", "status": "completed", "duration_requested_s": 1, "duration_actual_s": 1.0, "started_utc": "x"},
            "environment": {"python": "3", "platform": "l", "gpu_name": "g", "seed": 1}, "config": {}, "definitions": {"t0": "x"}, "events": {},
            "metrics": {**{k: None for k in documents.METRIC_KEYS}, "photon_to_answer_ms": block,
                        "queue_depth": {"q": {"max": 2, "mean": 1.0, "n_samples": 2, "series": [[1.0, 1], [2.0, 2]]}}}}
    bad = json.loads(json.dumps(good))
    bad["run"].update(name="bad", status="odd")
    bad["metrics"]["photon_to_answer_ms"] = {**block, "n": 0, "p95": None}
    del bad["metrics"]["vram"], bad["config"]
    (tmp_path / "d.json").write_text(json.dumps(good) + "\n" + json.dumps(bad) + "\n")
    docs = documents.read(spark, str(tmp_path / "d.json"), multi_line=False)
    assert {(r.run_id, r.rule) for r in documents.violations(docs).collect()} == {
        ("bad", "run.status unknown"), ("bad", "photon_to_answer_ms incomplete"), ("bad", "photon_to_answer_ms empty")}
    with pytest.raises(Exception, match="bad metrics document"):
        documents.violations(docs, strict=True).collect()
    lines = spark.read.text(str(tmp_path / "d.json"))
    assert {(r.run_id, r.missing) for r in documents.missing_keys(lines).collect()} == {("bad", "config"), ("bad", "metrics.vram")}
    assert documents.depth_series(docs.filter("run.name = 'ok'")).count() == 2
    broken = {r.run_id for r in documents.violations(docs).collect()}
    good = docs.where(~docs["run.name"].isin(*broken))
    if good.count():
        documents.write_valid(good, str(tmp_path / "good"))
        assert spark.read.text(str(tmp_path / "good")).count() == good.count()
    with pytest.raises(Exception, match="breaks: "):
        documents.write_valid(docs, str(tmp_path / "all"))
    assert not (tmp_path / "all" / "_SUCCESS").exists()


def test_document_and_overflow_hold_the_whole_series(spark):
    rows = [("r", q, float(i), i % 7) for q, n in (("long", 50), ("short", 3)) for i in range(n)]
    laid = lay_out(spark.createDataFrame(rows, "run_id string, queue string, t double, depth int"), ["run_id", "queue"], ["t"])
    (doc,) = documents.depth_blocks(laid, "run_id", "queue", points=20).collect()
    rest = sorted((r.point, r.t_rel, r.depth) for r in documents.overflow_points(laid, points=20).collect())
    held = doc.queue_depth["long"].series
    assert doc.truncated and [tuple(p) for p in held] + [(t, d) for _, t, d in rest] == [(float(i), i % 7) for i in range(50)]
    assert len(doc.queue_depth["short"].series) == 3 and rest[0][0] == 20
    assert not documents.depth_blocks(laid, "run_id", "queue").first().truncated


def test_failing_rows_become_errors(spark):
    def load():
        def fn(pdf):
            if (pdf["x"] == 3).any():
                raise RuntimeError("no")
            return [f"v{x}" for x in pdf["x"]]

        return fn

    d = {r.x: (r.answer, r.error) for r in answer_fired(spark.range(5).selectExpr("id as x").coalesce(1), load, ["x"]).collect()}
    assert d[3] == (None, "RuntimeError: no") and d[4] == ("v4", None)


def test_chat_request_order(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("hi", "AAAA")], "p string, i string")
    a = json.loads(df.select(chat_request(F.col("p"), F.col("i")).alias("j")).first().j)
    assert [x["type"] for x in a["messages"][0]["content"]] == ["text", "image_url"]
    assert (a["max_tokens"], a["temperature"], a["stream"]) == (32, 0.0, True)
    b = json.loads(df.select(chat_request(F.col("p"), F.col("i"), payload_first=True, system="s").alias("j")).first().j)
    assert b["messages"][0] == {"role": "system", "content": "s"}
    assert b["messages"][1]["content"][0]["image_url"]["url"].endswith(",AAAA")
