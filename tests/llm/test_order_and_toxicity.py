"""Training order (permutation, shards, resuming) and toxicity (grammar, held-out accuracy)."""

import random

import numpy as np
import pytest

from streamlens.llm import toxicity as X
from streamlens.llm import training_order as T


# -- training order ----------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    slots = T.permute(np.arange(n), n, 7)
    assert sorted(slots.tolist()) == list(range(n))
    assert (T.permute(slots, n, 7, inverse=True) == np.arange(n)).all()
    if n > 100:
        assert (T.permute(np.arange(n), n, 8) != slots).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.1


def documents(spark, n=400):
    rng = random.Random(0)
    rows = [(i, None if i % 50 == 7 else "" if i % 50 == 8 else " ".join(rng.choice(["alpha", "βeta", "x9", "…", "the\n"]) for _ in range(rng.randrange(1, 200))), i) for i in range(n)]
    rows += [(5, "again " * 20_000, 1), (5, "again " * 20_000, 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, slot int")


def test_shards_hold_every_token_once_at_its_slot(spark):
    rows, df = documents(spark)
    df = df.repartition(3)
    manifest, read = T.written(df, length=64, shard_rows=50, key=3)
    made = {}
    offsets, at = {}, 0
    seqs = T.sequences(df, 64).collect()
    for p in sorted({r.part for r in seqs}):
        offsets[p] = at
        at += sum(r.part == p for r in seqs)
    for r in seqs:
        made[offsets[r.part] + r.k] = (bytes(r["ids"]), r.n_tokens)
    assert manifest["n"] == len(made) == at
    slots = T.permute(np.arange(at), at, 3)
    got = {r.slot: bytes(r.ids) for r in read.collect()}
    assert got == {int(slots[i]): made[i][0] for i in made}
    # all documents, closed by END, are there token for token
    import public_tokenizers as P

    coder = T._coder(P.path(T.VOCABULARY))
    want = sum(len(coder.encode_ordinary(t or "")) + 1 for _, t, _ in rows)
    assert sum(n for _, n in made.values()) == want
    ids = np.concatenate([np.frombuffer(made[i][0], "<u2")[: made[i][1]] for i in sorted(made)])
    texts = sorted(coder.decode([int(x) for x in part]) for part in np.split(ids, np.flatnonzero(ids == T.END) + 1)[:-1] for part in [part[:-1]])
    assert texts == sorted(t or "" for _, t, _ in rows)


def test_files_have_a_fixed_stride_and_reading_resumes(spark):
    _, df = documents(spark, 100)
    manifest, read = T.written(df, length=32, shard_rows=16)
    files = {r.path.rsplit("/", 1)[1][:10]: bytes(r.content) for r in spark.read.format("binaryFile").load(manifest["path"]).collect()}
    whole = {r.slot: bytes(r.ids) for r in read.collect()}
    for slot in (0, 15, 16, manifest["n"] - 1):
        data, at = files[f"part-{slot // 16:05d}"], slot % 16 * manifest["stride"]
        assert data[at : at + 64] == whole[slot] and data[at + 64 : at + 65] == b"\n"
    later = T.read_shards(spark, manifest, from_slot=37)
    assert {r.slot: bytes(r.ids) for r in later.collect()} == {s: v for s, v in whole.items() if s >= 37}


def test_no_documents(spark):
    _, df = documents(spark, 1)
    manifest, read = T.written(df.limit(0))
    assert manifest["n"] == 0 and read.collect() == []


# -- toxicity -----------------------------------------------------------------------------------------------
LEXICON = {"=idiot": 3.0, "^vejut": 2.0}


def strongest(text):
    return X.Grammar(LEXICON).features(text.encode())[0]


def test_the_grammar_weighs_clauses():
    plain = strongest("what an idiot")
    assert plain == 3.0 and strongest("nothing here.") == 0.0
    assert strongest("you idiot") == 4.5 and strongest("he is an idiot, you see") == 4.5
    assert strongest("not an idiot") == 0.75 and strongest("never said such a long thing about an idiot") == 1.5
    assert strongest('she wrote: "idiot"') == 1.5 and strongest("he said idiot") == 2.25
    assert strongest("idiot. idiot idiot") == 6.0 and strongest("vejutaine") == 2.0 and strongest("veju") == 0.0
    assert strongest("i will kill you") == 3.0 and strongest("you die") == 0.0 and strongest("you. idiot") == 3.0
    assert strongest("you will surely die, i will kill you") == 9.0
    assert X.Grammar(LEXICON).features(b"") == (0.0,) * 5


def test_composition_equals_running_the_parts():
    parts = (X.INSULTS, X.THREATS, X.TARGETED, X.NEGATED, X.REPORTED)
    to, out = X.compose(*parts)
    rng = random.Random(1)
    state, states = 0, [0] * len(parts)
    for _ in range(5000):
        c = rng.randrange(8)
        moves = [p.step[s][c] for p, s in zip(parts, states)]
        assert out[state][c] == {m[1] for m in moves if m[1]}
        state, states = to[state][c], [m[0] for m in moves]


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = X.score(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    pos, neg = rows["score"][rows["toxic"] == 1].to_numpy(), rows["score"][rows["toxic"] == 0].to_numpy()
    auc = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)
    assert auc > 0.9 and (rows["predicted"] == rows["toxic"]).mean() > 0.95
    assert out.where("held_out <> (crc32(cast(cast(doc_id as string) as binary)) % 5 = 0)").count() == 0
    # labels that are held out change nothing
    other = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end toxic")
    again = X.score(docs, other).select("doc_id", "score")
    assert again.exceptAll(out.select("doc_id", "score")).count() == 0


def test_edge_rows(spark):
    rows = [(None, "you idiot", 1), (1, None, 1), (2, "", 1), (3, "a " * 1_000_000, 1), (4, "idiot", 1), (4, "idiot", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = X.score(df, none).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == 0 for r in out)
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (3, 0, 0), (4, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert len(X.score(df, odd).collect()) == 6 and X.score(df.limit(0), odd).collect() == []
