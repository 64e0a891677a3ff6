"""Training order: every sequence gets a global slot by a keyed permutation; shards hold the slots at a fixed stride."""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlens.llm.common import shared_path, stored, text_bytes
from streamlens.llm.kernels import mix, release
from streamlens.llm.tokens import chunks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Id that ends a document, free in that vocabulary.
END = 50256
ROUNDS = 6


# -- the permutation --------------------------------------------------------------------------------
def _feistel(x: np.ndarray, bits: int, key: int, inverse: bool) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        salt = np.uint64((key + 0x9E3779B97F4A7C15 * (r + 1)) & ((1 << 64) - 1))
        if inverse:
            left, right = right ^ (mix(left ^ salt) & mask), left
        else:
            left, right = right, left ^ (mix(right ^ salt) & mask)
    return (left << np.uint64(bits)) | right


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Slots of sequence numbers in [0, n) (or, inverse, the numbers of slots).

    A balanced Feistel network permutes the smallest power of four that holds n; a value at or over n is put through it
    again until it falls below. It walks a cycle of the permutation, so the result is a permutation of [0, n); fewer than
    four steps are expected.
    """
    bits = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    x = np.asarray(index, np.uint64).copy()
    with np.errstate(over="ignore"):
        x = _feistel(x, bits, key, inverse)
        out = np.flatnonzero(x >= np.uint64(n))
        while len(out):
            x[out] = _feistel(x[out], bits, key, inverse)
            out = out[x[out] >= np.uint64(n)]
    return x.astype(np.int64)


# -- sequences --------------------------------------------------------------------------------------
@lru_cache(maxsize=2)
def _coder(path: str):
    import public_tokenizers as P
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sequences(docs: DataFrame, length: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """(part, k, n_tokens, ids): the documents' ids, each document closed by END, end to end in sequences of ``length``;
    part and k count them inside a partition. The last of a partition is filled up with END; n_tokens says how many are
    real. ``ids``: little-endian unsigned 16-bit numbers."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches):
        coder, part, k = _coder(path), TaskContext.get().partitionId(), 0
        held, size = [], 0

        def cut(ids, n_tokens):
            nonlocal k
            n = len(ids) // length
            blobs = [ids[i * length : (i + 1) * length].astype("<u2").tobytes() for i in range(n)]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(k, k + n, dtype=np.int64)), pa.array(np.full(n, n_tokens, np.int32)), pa.array(blobs, pa.binary())],
                ["part", "k", "n_tokens", "ids"])
            k += n
            return batch

        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                for t in texts:
                    held.append(np.append(np.array(coder.encode_ordinary(t.decode("utf-8", "replace")), np.uint16), np.uint16(END)))
                    size += len(held[-1])
                if size >= 128 * length:
                    ids = np.concatenate(held)
                    full = len(ids) // length * length
                    yield cut(ids[:full], length)
                    held, size = [ids[full:]], len(ids) - full
        ids = np.concatenate(held) if held else np.empty(0, np.uint16)
        full = len(ids) // length * length
        if full:
            yield cut(ids[:full], length)
        if len(ids) > full:
            rest = np.full(length, END, np.uint16)
            rest[: len(ids) - full] = ids[full:]
            yield cut(rest, len(ids) - full)
        release()

    return docs.select(text_bytes()).mapInArrow(run, "part int, k long, n_tokens int, ids binary")


def materialise(docs: DataFrame, path: str, key: int = 20240229, length: int = 4096, shard_rows: int = 1024, vocabulary: str | None = None) -> dict:
    """Write the shards of a table of documents (text) under ``path``; returns the manifest.

    Sequence i of n (by partition and place in it) goes to slot permute(i, n, key). Shard s is one file with the slots from
    s * shard_rows on, in order; slot t is at byte (t mod shard_rows) * stride. A record is 2 * length bytes of ids and one
    line feed. A null or empty text is one END; repeated rows are kept; other columns are ignored; an empty table leaves no
    shard. Sequences are stored once before they are numbered, since numbers need the counts of all partitions; the number
    of partitions, not of rows, bounds what the driver sees. Each shard is one partition of a single shuffle, which sequences
    cross as zlib streams.
    """
    spark = docs.sparkSession
    made = stored(sequences(docs, length, vocabulary), "sequences", compression="zstd", **{"parquet.compression.codec.zstd.level": "9"})
    counts = sorted((r["part"], r["n"]) for r in made.groupBy("part").agg(F.count("*").alias("n")).collect())
    n = sum(c for _, c in counts)
    offsets = dict(zip((p for p, _ in counts), np.cumsum([0] + [c for _, c in counts]).tolist()))
    starts = spark.sparkContext.broadcast(offsets)
    shards = max(1, -(-n // shard_rows))

    def place(batches):
        for batch in batches:
            part = batch.column(0).to_numpy()
            first = np.array([starts.value[p] for p in part.tolist()], np.int64)
            slot = permute(first + batch.column(1).to_numpy(), n, key) if len(part) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array([zlib.compress(b.as_buffer(), 1) for b in batch.column(3)], pa.binary())], ["slot", "blob"])

    placed = made.mapInArrow(place, "slot long, blob binary").withColumn("shard", F.expr(f"cast(slot div {shard_rows} as int)"))
    ordered = placed.repartitionById(shards, "shard").sortWithinPartitions("slot")

    def plain(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.decompress(b.as_buffer()) for b in batch.column(0)], pa.binary())], ["ids"])

    if n:
        ordered.select("blob").mapInArrow(plain, "ids binary").select(F.col("ids").cast("string").alias("value")).write.option("lineSep", "\n").text(path)
    return {"path": path, "n": n, "key": key, "length": length, "shard_rows": shard_rows, "stride": 2 * length + 1, "shards": shards}


def read_shards(spark: SparkSession, manifest: dict, from_slot: int = 0) -> DataFrame:
    """(slot, ids as little-endian 16-bit bytes) of all slots from ``from_slot`` on: a run resumes by skipping whole shard
    files and, in the first, ``stride`` bytes a slot. A shard whose size is not a whole number of records is an error."""
    stride, rows, n = manifest["stride"], manifest["shard_rows"], manifest["n"]
    if not n:
        return spark.createDataFrame([], "slot long, ids binary")

    def parse(batches):
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer(data.as_buffer(), np.uint8)
                want = min(rows, n - shard * rows)
                if len(raw) != want * stride:
                    raise ValueError(f"shard {shard} has {len(raw)} bytes, not {want} records of {stride}")
                grid = raw.reshape(want, stride)
                if (grid[:, -1] != 10).any():
                    raise ValueError(f"shard {shard} is not aligned")
                for lo in range(max(0, from_slot - shard * rows), want, 2048):
                    some = grid[lo : min(want, lo + 2048), :-1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(lo, lo + len(some), dtype=np.int64) + shard * rows), pa.array([x.tobytes() for x in some], pa.binary())], ["slot", "ids"])

    files = spark.read.format("binaryFile").load(manifest["path"])
    shard = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    return files.select(shard.alias("shard"), "content").where(F.col("shard") >= from_slot // rows).mapInArrow(parse, "slot long, ids binary")


def manifest_json(manifest: dict) -> str:
    return json.dumps(manifest, sort_keys=True)


def written(docs: DataFrame, **how) -> tuple[dict, DataFrame]:
    """Materialise into a new place in the shared folder and read all slots back."""
    manifest = materialise(docs, shared_path(docs.sparkSession, "shards"), **how)
    return manifest, read_shards(docs.sparkSession, manifest)
