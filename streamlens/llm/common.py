"""Shared steps of the corpus operators: tables in the shared folder, key exchange in blocks, links and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlens.llm.kernels import mix, release
from streamlens.session import shared_path, ship_package, stored  # noqa: F401  (the operators take them from here)

#: Hashes a map task holds before it hands them on.
BLOCK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text; null stays null. Workers get bytes, so nothing is decoded on the way."""
    return F.col(column).cast("binary")


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df under column names that no operator uses, and the names to give back."""
    back = {f"__col{i}": n for i, n in enumerate(df.columns)}
    return df.toDF(*back), back


def one_text_per_id(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with one row for each id that is not null. Where an id comes with several texts its greatest text
    (in byte order; null last) stands for it. The texts are shuffled only if an id does repeat."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    twice = rows.groupBy("doc_id").count().where("count > 1").limit(1)
    return rows.groupBy("doc_id").agg(F.max("text").alias("text")) if twice.count() else rows


@contextmanager
def shuffles_dropped(spark: SparkSession, small: bool = False):
    """Inside, Spark removes the shuffle files of a write as soon as it is done, not when the driver next collects garbage. For
    steps that hand on through ``stored`` tables, which need none of them again. ``small``: and workers get ``small_batches``."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **(small_batches() if small else {})}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def small_batches() -> dict[str, str]:
    """Settings for rows with much in them, of which a batch of the usual number of rows would be large in the JVM and in the worker."""
    return {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def dropped(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that all steps which read them have been written after."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- exchange of hashes in blocks ------------------------------------------------------------------
def exchange(source: DataFrame, emit: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]],
             receive: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]], kinds: tuple[str, ...], schema: str) -> DataFrame:
    """Bring equal hashes together. ``emit`` gives arrays (uint64 hashes, then columns of numpy types ``kinds[1:]``); every
    hash range is one ``receive`` call with the concatenated arrays, hashes renamed one to one.

    A hash travels as its low 48 bits; with its range it keeps 56 bits or more, and as many more as there are ranges.

    Rows of a hash never leave their range, and a range holds what 1/8 of a shuffle partition does, so memory is bounded by
    the size of partitions; a hash that is in a third of all documents costs its entries, 8 to 20 bytes each.
    """
    spark = source.sparkSession
    n = partitions(spark)
    ranges = 8 * n
    shift = np.uint64(32)

    def narrow(col):
        """A base, and the differences from it in 32 bits if they fit: ids of one task are often close to each other."""
        base = int(col.min())
        span = int(col.max()) - base
        return np.int64(base).tobytes(), (col - base).astype(np.uint32) if span < 1 << 32 else col - np.int64(base)

    def widen(blob, n):
        base = np.frombuffer(blob[:8], np.int64)[0]
        return np.frombuffer(blob[8:], np.uint32 if len(blob) == 8 + 4 * n else np.int64).astype(np.int64) + base

    def cut(held):
        cols = [np.concatenate(c) for c in zip(*held)]
        heads = [b""] * len(cols)
        raw = np.ascontiguousarray(cols[0]).view(np.uint8).reshape(-1, 8)[:, :6]
        for i, kind in enumerate(kinds):
            if kind is np.int64:
                heads[i], cols[i] = narrow(cols[i])
        part = ((cols[0] >> shift) * np.uint64(ranges)) >> shift
        order = np.argsort(part.astype(np.uint16) if ranges <= 1 << 16 else part, kind="stable")  # 16 bits are dealt, not compared
        cols, part = [raw[order], *(c[order] for c in cols[1:])], part[order]
        at = np.searchsorted(part, np.arange(ranges + 1))
        full = np.flatnonzero(np.diff(at))
        for some in np.array_split(full, max(1, len(full) // 256)):
            blobs = [pa.array([h + c[at[k] : at[k + 1]].tobytes() for k in some], pa.binary()) for h, c in zip(heads, cols)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *blobs], ["part", *(f"c{i}" for i in range(len(cols)))])

    def send(batches):
        release(caches=True)
        held, size = [], 0
        for batch in batches:
            for arrays in emit(batch):
                if len(arrays[0]):
                    held.append(arrays)
                    size += len(arrays[0])
                    if size >= BLOCK:
                        yield from cut(held)
                        held, size = [], 0
        if held:
            yield from cut(held)
        del held
        release()

    def take(batches):
        held, part = [], None
        for batch in batches:
            parts = batch.column(0).to_numpy()
            for k in range(batch.num_rows):
                if parts[k] != part:
                    if held:
                        yield from receive([np.concatenate(c) for c in zip(*held)])
                    held, part = [], parts[k]
                blobs = [batch.column(i + 1)[k].as_py() for i in range(len(kinds))]
                n = len(blobs[0]) // 6
                low = np.zeros((n, 8), np.uint8)
                low[:, :6] = np.frombuffer(blobs[0], np.uint8).reshape(n, 6)
                name = mix(low.view(np.uint64).ravel() ^ mix(np.array([parts[k]], np.uint64)))
                held.append([name, *(widen(b, n) if t is np.int64 else np.frombuffer(b, t) for b, t in zip(blobs[1:], kinds[1:]))])
        if held:
            yield from receive([np.concatenate(c) for c in zip(*held)])
        del held
        release()

    blocks = source.mapInArrow(send, "part int, " + ", ".join(f"c{i} binary" for i in range(len(kinds))))
    return blocks.repartition(n, "part").sortWithinPartitions("part").mapInArrow(take, schema)


def joined_values(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """Binary values of ``n`` elements each, one after the other in ``values``."""
    ends = np.concatenate([[0], np.cumsum(n)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def flat_values(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The elements of binary values, one value after the other, and where each begins and the last ends. A null has none."""
    if column.null_count:
        column = column.fill_null(b"")
    buffers, size = column.buffers(), np.dtype(kind).itemsize
    ends = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    return data.view(kind), (ends - ends[0]) // size


def block_counts(blocks: DataFrame) -> DataFrame:
    """``blocks`` (block, hashes, n, of, special, ...) with ``df``: for every hash of a block the number of its occurrences in all blocks
    in 16 bits (65,535 at most), 0 where all of them are in sets ``of`` one owner and none is special. ``block`` is unique; ``hashes`` are
    the different ones of each set, ``n`` tells how many they are. All are the bytes of arrays: uint64, int64, int64 and uint8.

    Hashes, owners and marks go to the range of the hash and counts come back, two bytes each in the order of the block, so nothing but
    them has to travel twice. Memory is bounded as in ``exchange``.
    """
    n = partitions(blocks.sparkSession)
    ranges = 8 * n

    def dealt(hashes):
        part = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        order = np.argsort(part.astype(np.uint16) if ranges <= 1 << 16 else part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(ranges + 1))

    def send(batches):
        release(caches=True)
        for batch in batches:
            for r in range(batch.num_rows):
                hashes, n, owner, special = (np.frombuffer(batch.column(i + 1)[r].as_buffer(), k) for i, k in enumerate((np.uint64, np.int64, np.int64, np.uint8)))
                if not len(hashes):
                    continue
                owner, special = np.repeat(owner, n), np.repeat(special, n)
                order, at = dealt(hashes)
                base = int(owner.min())
                own = owner - base
                own = own.astype(np.uint32) if int(own.max()) < 1 << 32 else own
                cols = [np.ascontiguousarray(hashes[order]).view(np.uint8).reshape(-1, 8)[:, :6], own[order], special[order]]
                full = np.flatnonzero(np.diff(at))
                for some in np.array_split(full, 1 + len(full) // 256):
                    blobs = [pa.array([c[at[k] : at[k + 1]].tobytes() for k in some], pa.binary()) for c in cols]
                    same = [pa.array(np.full(len(some), x, np.int64)) for x in (batch.column(0)[r].as_py(), base)]
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *same, *blobs], ["part", "block", "base", "hashes", "owner", "special"])
        release()

    def answer(part, held):
        block, hashes, owner, special = zip(*held)
        sizes = np.array([len(x) for x in special])
        hashes, owner, special = (np.concatenate(x) for x in (hashes, owner, special))
        order = np.argsort(hashes)
        hashes, owner, special = hashes[order], owner[order], special[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        times = np.diff(np.append(first, len(hashes)))
        apart = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)) | (np.maximum.reduceat(special, first) == 1)
        df = np.empty(len(hashes), np.uint16)
        df[order] = np.repeat(np.where(apart & (times > 1), np.minimum(times, 65_535), 0), times)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(block, np.int64)), pa.array(np.full(len(block), part, np.int32)), joined_values(df, sizes)], ["block", "part", "df"])

    def take(batches):
        held, part = [], None
        for batch in batches:
            parts = batch.column(0).to_numpy()
            for k in range(batch.num_rows):
                if parts[k] != part:
                    if held:
                        yield answer(part, held)
                    held, part = [], parts[k]
                special = np.frombuffer(batch.column(5)[k].as_py(), np.uint8)
                low = np.zeros((len(special), 8), np.uint8)
                low[:, :6] = np.frombuffer(batch.column(3)[k].as_py(), np.uint8).reshape(-1, 6)
                own = batch.column(4)[k].as_py()
                own = np.frombuffer(own, np.uint32 if len(own) == 4 * len(special) else np.int64).astype(np.int64) + batch.column(2)[k].as_py()
                held.append((batch.column(1)[k].as_py(), low.view(np.uint64).ravel(), own, special))
        if held:
            yield answer(part, held)
        del held
        release()

    def back(batches):
        for batch in batches:
            answers, ends = batch.column(1), np.asarray(batch.column(1).offsets)
            parts, dfs = (answers.values.field(k) for k in range(2))
            out = []
            for r in range(batch.num_rows):
                order, _ = dealt(np.frombuffer(batch.column(0)[r].as_buffer(), np.uint64))
                own = sorted(range(ends[r], ends[r + 1]), key=lambda k: parts[k].as_py())
                df = np.empty(len(order), np.uint16)
                df[order] = np.concatenate([np.frombuffer(dfs[k].as_buffer(), np.uint16) for k in own]) if own else df[:0]
                out.append(df.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *batch.columns[2:]], ["df", *batch.schema.names[2:]])

    sent = blocks.select("block", "hashes", "n", "of", "special").mapInArrow(send, "part int, block long, base long, hashes binary, owner binary, special binary")
    answers = sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(take, "block long, part int, df binary")
    answers = stored(answers, "counts").groupBy("block").agg(F.collect_list(F.struct("part", "df")).alias("answers"))
    rest = [c for c in blocks.columns if c not in ("of", "special")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*rest).schema)
    return blocks.join(answers, "block").select("hashes", "answers", *rest).mapInArrow(back, f"df binary, {kinds}")


# -- connected components ---------------------------------------------------------------------------
def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named by its smallest node.

    Alternating large-star and small-star steps, each written to the shared folder; the edges never meet in one place, a
    hub's minimum is aggregated before it is shuffled, and the join with the hub's row is one that Spark can split.
    """
    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").union(least.select(F.col("a").alias("x"), "m"))
        pairs = stored(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), name)
    heads = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(heads)


# -- links between sets that share a bucket -----------------------------------------------------------
#: Columns of a set's sketch.
SKETCH = ("bits0", "bits1", "bits2", "bits3")


def sketches(items: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Sketches of the sets of hashes that begin at ``first``: each element turns one bit of 64 for each of SKETCH."""
    place = mix(items ^ np.uint64(0x9E6C63D0876A9A47)) >> np.uint64(56)
    bit = np.uint64(1) << (place & np.uint64(63))
    return [np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == k, bit, np.uint64(0)), first).view(np.int64) for k in range(len(SKETCH))]


def common_elements(left: pa.Array, right: pa.Array) -> np.ndarray:
    """How many elements the sets of each row, sorted uint64 as bytes, have in common."""
    (x, at), (y, there) = (flat_values(c, np.uint64) for c in (left, right))
    n, m, both = np.diff(at), np.diff(there), np.zeros(len(left), np.int64)
    small = (n > 0) & (m > 0) & (n <= 64) & (m <= 64)
    rows = np.flatnonzero(small)
    rows = rows[np.argsort(n[rows] + m[rows], kind="stable")]  # alike in size
    for some in np.array_split(rows, 1 + len(rows) // 512):
        if len(some):
            i, j = np.arange(int(n[some].max())), np.arange(int(m[some].max()))
            # a row of fewer elements is filled up: the left one's are not counted, the right one's come twice
            a = x[np.minimum(at[some, None] + i, len(x) - 1)]
            b = y[there[some, None] + np.where(j < m[some, None], j, 0)]
            both[some] = ((a[:, :, None] == b[:, None, :]).any(axis=2) & (i < n[some, None])).sum(axis=1)
    for k in np.flatnonzero(~small & (n > 0) & (m > 0)):
        a, b = x[at[k] : at[k + 1]], y[there[k] : there[k + 1]]
        if len(a) > len(b):
            a, b = b, a
        place = np.searchsorted(b, a)
        place[place == len(b)] = 0
        both[k] = (b[place] == a).sum()
    return both


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets link: 100 * intersection >= percent * union. ``sets``: node, n (whole size), items (sorted
    uint64 as bytes; elements that no other set has may be left out), and perhaps owner: sets of one owner do not link."""
    def check(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            both = common_elements(batch.column(3), batch.column(5))
            keep = (both > 0) & (100 * both >= percent * (na + nb - both))
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    named = [c for c in ("owner",) if c in sets.columns]
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"), *(F.col(c).alias("oa") for c in named))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"), *(F.col(c).alias("ob") for c in named))
    full = pairs.join(left, "a").join(right, "b")
    full = (full.where("oa <> ob") if named else full).select("a", "b", "na", "ia", "nb", "ib")
    return full.mapInArrow(check, "a long, b long")


def merged(labels: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``labels`` (node, component) after the components that ``edges`` (a, b) connect became one. Only these are gone through."""
    if edges.isEmpty():
        return labels
    ends = edges
    for c in "ab":
        named = labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        ends = ends.join(named, c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    ends = stored(ends, f"{name}-ends")
    new = stored(components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), f"{name}-all"), f"{name}-new")
    bare = ends.where("of_a = a").select(F.col("a").alias("node")).union(ends.where("of_b = b").select("b")).distinct()
    every = labels.union(bare.join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))
    new = new.select(F.col("node").alias("component"), F.col("component").alias("into"))
    return every.join(new, "component", "left").select("node", F.coalesce("into", "component").alias("component"))


def link_components(members: DataFrame, sets: DataFrame, percent: int, name: str, few: int | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(node, component) for the graph of all pairs that share enough buckets and link.

    ``members``: bucket, node, n (set size), m (elements that some other set has), ell (buckets a pair must share, at least
    those of the less demanding of the two), pos (place of the bucket in the node's order of its elements, the same order for
    all nodes; 0 where buckets have none), and perhaps sketches (see ``sketches``) of those m elements: as many elements as two
    sketches differ in bits are certainly in one of the sets only, so most pairs that do not link are told in the join.
    ``sets``: see ``verified``. Nodes in no link are left out. ``labels`` (node, component): links that are known; with them, ``members`` may
    hold some buckets only and all pairs that share one of them count, as those they share besides are not seen.

    Of a linked pair's shared elements the first ell have a place before which too few elements of either set remain to
    spoil the intersection that the two sizes ask for. Rows behind that place, which is that of the pair and not of its
    least possible partner, are never met; so two variants of one text meet only if they share what sets them apart from it.

    Large groups of copies are contracted first: every node is verified against one other node, a central member of the
    bucket most of its buckets point to, and linked nodes become one component. Only pairs between different components can
    change the result from then on. Rounds go on while they take a twentieth of such pairs and more than ``few`` are left (a
    round reads all members several times, so by default a quarter of their number); then all of them are counted per pair
    and verified. So groups cost about a pair for each member and no link is lost.
    """
    members = stored(members.where(100 * F.col("m") >= percent * F.col("n")), f"{name}-members")
    few = max(200_000, members.count() // 4) if few is None else few
    known, left, r = labels is not None, float("inf"), 0 if labels is None else 1
    while True:
        if labels is None:
            now = members.withColumn("comp", F.col("node"))
        else:
            now = stored(members.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"), f"{name}-now")
        counted = now.groupBy("bucket", "comp").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("q"))
        open_pairs = counted.agg(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2)).first()[0] or 0
        if not open_pairs:
            return labels if labels is not None else members.select("node", F.col("node").alias("component")).limit(0)
        if r > 0 and (open_pairs <= few or 100 * open_pairs > 95 * left):
            break
        left = open_pairs
        rank = F.struct(F.round(-F.col("m") / F.col("n"), 2).alias("x"), F.col("node").alias("y")) if r == 0 else F.struct(F.xxhash64("node", F.lit(r)).alias("x"), F.col("node").alias("y"))
        if r == 0:
            # the most central member of a bucket and, for itself, the next
            ends = now.groupBy("bucket").agg(F.min(rank).alias("p"), F.count("*").alias("m")).where("m > 1").select("bucket", F.col("p.y").alias("h"), F.lit(None).cast("long").alias("g"), F.lit(-1).cast("long").alias("hc"))
        else:
            # one of the component that has most of the bucket's members and, for its members, one of the next
            each = now.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.min(rank).alias("k")).select("bucket", F.struct("m", "k", "comp").alias("x"))
            ends = each.groupBy("bucket").agg(F.max("x").alias("p"), F.min("x").alias("q")).where("p.comp <> q.comp").select(
                "bucket", F.col("p.k.y").alias("h"), F.col("q.k.y").alias("g"), F.col("p.comp").alias("hc"))
        met = now.join(ends, "bucket").withColumn("other", F.when(F.col("comp") == F.col("hc"), F.col("g")).otherwise(F.col("h"))).where("other <> node")
        votes = met.groupBy("node", "other").agg(F.count("*").alias("c"))
        best = votes.groupBy("node").agg(F.max(F.struct("c", "other")).alias("v"))
        pairs = best.select(F.least("node", "v.other").alias("a"), F.greatest("node", "v.other").alias("b")).distinct()
        found = verified(pairs, sets, percent)
        edges = stored(found if known or labels is None else found.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))), f"{name}-edges")
        labels = stored(merged(labels, edges, name) if known else components(edges, f"{name}-star"), f"{name}-labels")
        r += 1
    live = now.join(counted.where("m * m > q").select("bucket"), "bucket")
    bits = [c for c in SKETCH if c in members.columns]
    a, b = (live.select("bucket", *(F.col(c).alias(c + s) for c in ("node", "n", "m", "ell", "pos", "comp", *bits))) for s in "ab")
    apart = F.col("na") - F.col("ma") + F.col("nb") - F.col("mb")
    for c in bits:
        apart = apart + F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b")))
    met = a.join(b, "bucket").where(
        (F.col("nodea") < F.col("nodeb")) & (F.col("compa") != F.col("compb"))
        & ((100 + percent) * F.least("ma", "mb") >= percent * (F.col("na") + F.col("nb")))
        & ((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb")))
        & ((100 + percent) * (F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) + F.least("ella", "ellb") - 1) >= percent * (F.col("na") + F.col("nb"))))
    shared = met.groupBy("nodea", "nodeb").agg(F.count("*").alias("c"), F.first(F.lit(1) if known else F.least("ella", "ellb")).alias("need")).where("c >= need")
    found = verified(shared.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")), sets, percent)
    if known:
        return merged(labels, stored(found, f"{name}-found"), name)
    edges = found.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return components(edges, f"{name}-all")
