"""The registered queries and the pipeline on the small tables."""

from collections import defaultdict

import numpy as np
import oracle
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from streamlens.llm import decontaminate, paragraph_dedup, queries
from streamlens.llm.tokens import vocabulary_path
from test_leaks import brute as leaks
from test_near_copies import brute as near

PATH = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, PATH), oracle.connect(PATH), queries.SQL[name]) is None


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_op4_covers_every_token(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_cost_packing"](spark, PATH).collect()
    t = Tokenizer.from_file(vocabulary_path())
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
        seqs[r.sequence_id].append((r.offset, r.length))
    import zlib

    assert set(pieces) == set(docs)
    for d in list(docs)[:200]:
        ids = np.array([*t.encode(docs[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, n, crc in sorted(pieces[d]):
            assert start == at and crc == zlib.crc32(ids[at : at + n].tobytes())
            at += n
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048


def test_op5_on_the_documents(spark):
    """Of documents that share 50 words every one is reported; brute force over all pairs of windows."""
    docs = {r.doc_id: (r.text or "").encode().lower().split() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    windows = defaultdict(set)
    for d, w in docs.items():
        for i in range(len(w) - 49):
            windows[tuple(w[i : i + 50])].add(d)
    want = {d for g in windows.values() if len(g) > 1 for d in g}
    got = queries.QUERIES["op5_paragraph_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert want <= {r.doc_id for r in got}
    assert all(r.removed == (r.doc_id > r.keeper) for r in got)


def test_op8_every_slot_once(spark):
    rows = queries.QUERIES["op8_training_order"](spark, PATH).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == sorted(r.sequence for r in rows) == list(range(n))


def test_pipeline_by_stages(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    names = docs.columns
    (_, rules), (_, copies), (_, repeats), (_, leaks_), (_, pack) = corpus_pipeline.STAGES
    good = rules(spark, docs, PATH)
    judged = {r.doc_id: r.kept for r in queries.QUERIES["op7_host_rules"](spark, PATH).collect()}
    good_rows = [tuple(r) for r in good.collect()]
    assert good.columns == names and {r[0] for r in good_rows} == {d for d, k in judged.items() if k}
    some = spark.createDataFrame(good_rows[:300], docs.schema)
    one = copies(spark, some, PATH)
    want = near([(r[0], r[1]) for r in good_rows[:300]])
    kept = [tuple(r) for r in one.collect()]
    assert one.columns == names and sorted(r[0] for r in kept) == sorted(i for i, (_, c) in want.items() if i == c)
    cut = repeats(spark, one, PATH)
    assert cut.columns == names and cut.count() == len(kept) and paragraph_dedup.repeats(cut).where("doc_id > keeper").count() == 0
    clean = leaks_(spark, cut, PATH)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    found = leaks([(r.doc_id, r.text) for r in cut.collect()], items)
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == {d for d, (_, hit, _) in found.items() if not hit}
    packed = pack(spark, clean, PATH).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}


def test_run_is_all_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns and decontaminate is not None
