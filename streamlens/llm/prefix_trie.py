"""Conversation prefix trie: shared beginnings of conversations as nodes, subtree totals by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm.common import partitions, stored
from streamlens.operators.layout import lay_out

#: Nodes of a shard, about; ids that stand together in a shard; and levels after which a deep path goes on in another shard.
SHARD_NODES, FAMILY, DEEP = 200_000, 100, 100_000
#: Messages that a queue keeps in memory before it writes a sorted run.
QUEUE_ROWS = 200_000
#: Shard roots that one task sweeps by itself; more of them are sharded once more, sixteen shards to one.
ROOTS = 1_000_000
_KEY = ["k1", "k2", "k3", "k4"]


# -- conversations -------------------------------------------------------------------------------------------------
def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos from 0, f1, f2, chars): turns in order, with two fingerprints of (role, text) and the text's length.

    Order: turn, null first; rows of one turn by role, then by their fingerprints, so equal rows stay neighbours and any order of
    the table gives one answer. A null role or text is empty; rows without conv_id belong to no conversation and are left out.
    A conversation too large for one task is cut and counted in parts (``lay_out``).
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv is not null")
    rows = rows.select("conv", "turn", "role", F.xxhash64(F.lit(1), "role", "text").alias("f1"), F.xxhash64(F.lit(2), "role", "text").alias("f2"), F.length("text").cast("long").alias("chars"))
    return lay_out(rows, ["conv"], ["turn", "role", "f1", "f2"]).row_number("pos").result().select("conv", "pos", "f1", "f2", "chars")


def with_shared_heads(turns: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """(conv, depth from 1, f1, f2, chars): the first h turns of the block's first conversation, then the conversation's own
    turns after its first h; h is crc32 of the id as text modulo ``heads``. Only the firsts' heads, at most heads - 1 rows each,
    are joined, once for each conversation of the block."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    base = F.col("conv") - F.col("conv") % block
    first = turns.where((F.col("conv") % block == 0) & (F.col("pos") < heads - 1)).select(F.col("conv").alias("base"), "pos", "f1", "f2", "chars")
    sizes = first.groupBy("base").agg(F.count("*").alias("has"))
    own = turns.withColumns({"h": h, "base": base}).where("pos >= h").join(sizes, "base", "left")
    own = own.select("conv", (F.least("h", F.coalesce("has", F.lit(0))) + F.col("pos") - F.col("h") + 1).alias("depth"), "f1", "f2", "chars")
    convs = turns.where("pos = 0").select("conv", h.alias("h"), base.alias("base"))
    shared = convs.join(first, "base").where("pos < h").select("conv", (F.col("pos") + 1).alias("depth"), "f1", "f2", "chars")
    return own.unionByName(shared)


# -- nodes ---------------------------------------------------------------------------------------------------------
def nodes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a node: conv, depth, pconv, n_convs, n_children, n_out (children in another shard), chars, ends, shard, pshard.

    The key of a prefix is its depth and the sum of fingerprints of (place, turn), in four parts of 32 bits so that no sum runs
    over: sums of a prefix and of the rest add up, so a huge conversation is keyed in parts, and the parent's key is the own one
    less the last turn. A node is told from others by 128 bits, and named by (smallest member, depth) from then on.
    """
    spark = convs.sparkSession
    mark = {"a": F.xxhash64("depth", "f1"), "b": F.xxhash64("depth", "f2")}
    marked = turns.withColumns(mark)
    part = {"k1": F.col("a").bitwiseAND(F.lit(0xFFFFFFFF)), "k2": F.shiftrightunsigned("a", 32), "k3": F.col("b").bitwiseAND(F.lit(0xFFFFFFFF)), "k4": F.shiftrightunsigned("b", 32)}
    cut = marked.select("conv", "depth", "chars", *[c.alias("s" + k[1]) for k, c in part.items()])
    keyed = lay_out(cut, ["conv"], ["depth"]).running(**{k: F.col("s" + k[1]) for k in _KEY}).result()
    up = [F.when(F.col("depth") > 0, F.col(k) - F.col("s" + k[1])).alias("p" + k[1]) for k in _KEY]
    zero = [F.lit(0).cast("long").alias(k) for k in _KEY]
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), *zero, *[F.lit(None).cast("long").alias("p" + k[1]) for k in _KEY])
    rows = stored(keyed.select("conv", "depth", "chars", *_KEY, *up).unionByName(root), "prefixes")
    over = ["p" + k[1] for k in _KEY]
    found = rows.groupBy("depth", *_KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), *[F.first(p).alias(p) for p in over])
    last = rows.groupBy("conv").agg(F.max(F.struct("depth", *_KEY)).alias("e")).select("conv", "e.*")
    found = stored(found.join(ends(last), ["depth", *_KEY], "left"), "nodes")
    shards = max(partitions(spark), -(-found.count() // SHARD_NODES))
    shard = lambda c, d: F.pmod(F.xxhash64(F.floor(F.col(c) / FAMILY), F.floor(F.col(d) / DEEP)), F.lit(shards))
    above = found.select(F.col("depth").alias("pdepth"), *[F.col(k).alias("p" + k[1]) for k in _KEY], F.col("conv").alias("pconv"))
    full = found.withColumn("pdepth", F.col("depth") - 1).join(above, ["pdepth", *over], "left")
    full = stored(full.select("conv", "depth", "pconv", "n_convs", "chars", "ends", shard("conv", "depth").alias("shard"), F.when(F.col("pconv").isNotNull(), shard("pconv", "pdepth")).alias("pshard")), "tree")
    below = full.where("pconv is not null").groupBy(F.col("pconv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("shard") != F.col("pshard")).alias("n_out"))
    return full.join(below, ["conv", "depth"], "left").fillna(0, ["n_children", "n_out"])


def ends(last: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end in a node, ascending, by node: sorted by Spark and read as a stream, so however many end in
    one node a task holds only a batch of them."""
    by = ["depth", *_KEY]

    def run(batches):
        now, digest, out = None, None, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for *key, conv in zip(*cols):
                if key != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*by, "ends"])
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], [*by, "ends"])

    return last.repartition(*by).sortWithinPartitions(*by, "conv").select(*by, "conv").mapInArrow(run, ", ".join(f"{c} long" for c in by) + ", ends string")


# -- time-forward processing ---------------------------------------------------------------------------------------
class SpillingQueue:
    """Messages (level, id, leaves, saved, inner) to nodes, deepest level first. Beyond ``limit`` they are sorted and written to
    Spark's scratch folder of the executor, in files without a name that go with the task, as Spark's own sorts do."""

    def __init__(self, limit: int = QUEUE_ROWS):
        self.limit, self.heap, self.runs, self.spilled = limit, [], [], 0

    def push(self, level: int, id_: str, leaves: int, saved: int, inner: list) -> None:
        heapq.heappush(self.heap, (-level, id_, leaves, saved, inner))
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        folder = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0]
        file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        self.heap.sort()
        for item in self.heap:
            pickle.dump(item, file)
        file.seek(0)
        self.spilled += 1
        self.heap = []
        self._next(self.spilled, file)

    def _next(self, number: int, file) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(file), number, file))
        except EOFError:
            file.close()

    def pop_for(self, level: int, id_: str) -> Iterator[tuple[int, int, list]]:
        """All messages to one node; nodes must ask in the order of the queue."""
        key = (-level, id_)
        while self.heap and self.heap[0][:2] == key:
            yield heapq.heappop(self.heap)[2:]
        while self.runs and self.runs[0][0][:2] == key:
            item, number, file = heapq.heappop(self.runs)
            self._next(number, file)
            yield item[2:]


_SWEPT = "kind int, shard long, id string, up string, leaves long, saved long"
_ROWS = ["shard", "level", "id", "given", "up", "ulevel", "ushard", "leaves", "saved", "out"]


def sweep(rows: DataFrame, totals: bool, limit: int = QUEUE_ROWS) -> DataFrame:
    """Every shard in reverse level order: a node adds what its children sent to its own and sends the sum to its parent.

    kind 0: the total of each node (if asked for); 1: of each piece whose parent is in another shard, or nowhere (up null);
    2: a node with children in other shards and the parent (up) of the piece it is in. ``rows``: see ``_ROWS``; rows with
    ``given`` 0 are totals from other shards to node ``id``.
    """
    def run(batches):
        shard, queue, out = None, None, []
        more = [0, 0]
        for batch in batches:
            for s, level, id_, given, up, ulevel, ushard, leaves, saved, has_out in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    shard, queue, more = s, SpillingQueue(limit), [0, 0]
                if not given:  # stands right before its node
                    more = [more[0] + leaves, more[1] + saved]
                    continue
                leaves, saved, more = leaves + more[0], saved + more[1], [0, 0]
                inner: list = []
                for a, b, below in queue.pop_for(level, id_):
                    leaves, saved = leaves + a, saved + b
                    inner, below = (inner, below) if len(inner) >= len(below) else (below, inner)
                    inner.extend(below)
                if totals:
                    out.append((0, s, id_, None, leaves, saved))
                elif has_out:
                    inner.append(id_)
                if up is not None and ushard == s:
                    queue.push(ulevel, up, leaves, saved, inner)
                elif not totals:
                    out.append((1, s, None, up, leaves, saved))
                    out.extend((2, s, i, up, 0, 0) for i in inner)
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    ordered = rows.select(*_ROWS).repartition("shard").sortWithinPartitions("shard", F.desc("level"), "id", "given")
    return ordered.mapInArrow(run, _SWEPT)


def _batch(out: list) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["kind", "shard", "id", "up", "leaves", "saved"])


def subtree_totals(tree: DataFrame, limit: int = QUEUE_ROWS, roots: int = ROOTS) -> DataFrame:
    """(id, leaves, saved) summed over the subtree of every node. ``tree``: shard, level, id, up, ulevel, ushard (null at the
    root), leaves, saved (own), out (has children in other shards).

    A first sweep gives what each shard sends to each node outside. These pieces, one row for a shard and a parent outside, are
    a tree again: the parent node lies in a piece of its own shard. That tree is swept the same way, in one shard if it is
    small, else with fewer shards; then every shard is swept once more with the totals from outside laid beside its nodes.
    """
    own = tree.select(*[F.lit(1).alias("given") if c == "given" else F.col(c) for c in _ROWS])
    first = stored(sweep(own, False, limit), "pieces")
    sums = first.where("kind = 1").groupBy("shard", "up").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    # nodes outside, the piece that each lies in, and its level
    name = F.concat_ws("|", F.col("shard").cast("string"), F.coalesce("up", F.lit("")))
    inside = first.where("kind = 2").select(F.col("id").alias("up"), name.alias("up_piece"), F.col("shard").alias("ushard"), F.col("up").alias("uup"))
    place = tree.where("out").select(F.col("id").alias("up"), F.col("level").alias("ulevel"))
    pieces = sums.withColumn("id", name).join(inside, "up", "left").join(place, "up", "left")
    outer = tree.where("out").select(F.col("id").alias("uup"), F.col("level").alias("uulevel"))
    pieces = stored(pieces.join(outer, "uup", "left"), "piece-tree")
    n = pieces.count()
    if n <= 1:
        given = pieces.limit(0)
    else:
        width = tree.agg(F.max("shard")).first()[0] + 1
        wide = max(1, width // 16) if n > roots and width > 1 else 1
        coarse = lambda c: F.floor(F.col(c) * wide / width)
        # a piece hangs below its outside parent, so that node's level orders the pieces; the root's piece is above all
        small = pieces.select(
            coarse("shard").alias("shard"), F.coalesce("ulevel", F.lit(-1)).alias("level"), "id", F.col("up_piece").alias("up"),
            F.when(F.col("up_piece").isNotNull(), F.coalesce("uulevel", F.lit(-1))).alias("ulevel"), F.when(F.col("up_piece").isNotNull(), coarse("ushard")).alias("ushard"),
            "leaves", "saved", F.lit(False).alias("out"))
        if wide == 1:
            done = sweep(small.withColumn("given", F.lit(1)), True, limit).select("id", "leaves", "saved")
        else:
            far = small.where("up is not null and shard <> ushard").select(F.col("up").alias("id")).distinct().withColumn("_out", F.lit(True))
            done = subtree_totals(small.drop("out").join(far, "id", "left").withColumn("out", F.coalesce("_out", F.lit(False))), limit, roots)
        given = pieces.select("id", F.col("up").alias("node"), F.col("ulevel").alias("level"), F.col("ushard").alias("nshard")).join(done, "id").where("node is not null")
        given = given.groupBy("nshard", "level", "node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        given = given.select(
            F.col("nshard").alias("shard"), "level", F.col("node").alias("id"), F.lit(0).alias("given"), F.lit(None).cast("string").alias("up"),
            F.lit(None).cast("long").alias("ulevel"), F.lit(None).cast("long").alias("ushard"), "leaves", "saved", F.lit(False).alias("out"))
        own = own.unionByName(given)
    return sweep(own, True, limit).select("id", "leaves", "saved")


def trie(conversations: DataFrame, block: int = 100, heads: int = 6, limit: int = QUEUE_ROWS, roots: int = ROOTS) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    Rebuilding: ``with_shared_heads`` of ``numbered_turns``, where nulls, ties and repeated rows are defined. Conversations without a
    rebuilt turn are members of the root alone. An empty table has no node. Further columns are not read. Subtree totals are
    passed from the leaves up by ``subtree_totals``: within shards of about SHARD_NODES nodes, then across the shards' roots.
    """
    turns = stored(numbered_turns(conversations), "turns")
    convs = turns.where("pos = 0").select("conv")
    tree = stored(nodes(convs, with_shared_heads(turns, block, heads)), "trie")
    id_ = lambda c, d: F.concat_ws(":", F.col(c).cast("string"), d.cast("string"))
    up = F.col("pconv").isNotNull()
    rows = tree.select(
        "shard", F.col("depth").alias("level"), id_("conv", F.col("depth")).alias("id"), F.when(up, id_("pconv", F.col("depth") - 1)).alias("up"),
        F.when(up, F.col("depth") - 1).alias("ulevel"), F.col("pshard").alias("ushard"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_out") > 0).alias("out"))
    totals = subtree_totals(rows, limit, roots)
    none = hashlib.sha256(b"").hexdigest()
    return tree.withColumn("id", id_("conv", F.col("depth"))).join(totals, "id").select(
        F.col("conv").alias("conv_id"), "depth", F.col("pconv").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256"))
