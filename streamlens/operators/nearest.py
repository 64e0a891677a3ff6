"""Exact search for the most alike earlier row, with an index of balls that rules out whole blocks of rows.

The rows of a stream are cut into blocks of alike rows. A ball (centre, radius) around a block bounds every dot product with
its rows: x·y <= x·centre + |x|·radius. A row visits only blocks whose bound is above the best it has already seen in its own
block and among the first rows of all others; so the answer is that of comparing with every row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlens.operators.layout import Laid, join_on, lay_out
from streamlens.session import stored

#: Most sides of hyperplanes that a cell of alike rows is named by.
SIDES = 16
#: Hyperplanes beyond those that would make as many cells as blocks: a ball around several kinds of rows rules out little.
FINER = 3
BLOCK = ["_cell", "_part"]
VECTOR = T.ArrayType(T.DoubleType())


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


@F.pandas_udf(T.IntegerType())
def _sides(x: pd.Series) -> pd.Series:
    """On which side of each of SIDES fixed hyperplanes a vector lies, one bit each."""
    held = _matrix(x)
    normals = np.random.default_rng(SIDES).normal(size=(held.shape[1], SIDES))
    return pd.Series((held @ normals > 0) @ (1 << np.arange(SIDES)[::-1]), dtype="int32")


def _earlier(sims: np.ndarray, later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Greatest value of each row among columns that come earlier; -inf where there is none or none is a number."""
    sims[(later[:, None] <= earlier[None, :]) | np.isnan(sims)] = -np.inf
    return sims.max(axis=1, initial=-np.inf)


#: Products of two sets of rows that a task holds at a time.
HELD = 1 << 20


def _best(x: np.ndarray, n: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Best dot product of each row of ``x`` with an earlier row of ``y``, a strip of rows after the other: memory does not grow
    with the product of both sizes."""
    best = np.full(len(x), -np.inf)
    for i in range(0, len(x), step := max(1, HELD // max(1, len(y)))):
        some = slice(i, i + step)
        best[some] = _earlier(x[some] @ y.T, n[some], at)
    return best


def _with_keys(out: pd.DataFrame, keys: list[str], key: tuple) -> pd.DataFrame:
    for i, k in enumerate(keys):
        out.insert(i, k, key[i])
    return out


def numbered(fired: Laid) -> DataFrame:
    """(keys, frame_idx, _n, _x): the rows that have an embedding, numbered in their stream's order."""
    rows = fired.row_number("_n").df.where("embedding is not null")
    return rows.select(*fired.keys, "frame_idx", "_n", F.col("embedding").cast(VECTOR).alias("_x"))


def blocks(fired: Laid, block: int) -> DataFrame:
    """(keys, frame_idx, _n, _x, _cell, _part): the rows of every stream in blocks of at most ``block`` rows. Streams of more
    than a block are first dealt to cells, 2 ** FINER for each full block, and each cell is cut along time."""
    keys = list(fired.keys)
    rows = numbered(fired)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    finer = F.when(F.col("_size") > block, F.ceil(F.log2(F.col("_size") / block)) + FINER).otherwise(0)
    sides = F.least(F.lit(SIDES), finer).cast("int")
    rows = join_on(rows, sizes.select(*keys, sides.alias("_sides")), keys)
    rows = stored(rows.withColumn("_code", _sides("_x")), "nearest-rows")
    rows = rows.withColumn("_cell", F.floor(F.col("_code") / F.pow(F.lit(2.0), SIDES - F.col("_sides"))).cast("int"))
    laid = lay_out(rows.drop("_code", "_sides"), [*keys, "_cell"], ["_n"]).row_number("_m")
    return stored(laid.result().withColumn("_part", F.floor(F.col("_m") / block)).drop("_m"), "nearest-blocks")


def within_streams(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame_idx, best_similarity) of ``numbered`` rows whose streams are each no larger than a block."""
    schema = T.StructType([*[rows.schema[c] for c in [*keys, "frame_idx"]], T.StructField("best_similarity", T.DoubleType())])

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = _matrix(pdf["_x"]), pdf["_n"].to_numpy()
        best = _best(x, n, x, n)
        out = pd.DataFrame({"frame_idx": pdf["frame_idx"].to_numpy(), "best_similarity": best})
        return _with_keys(out[np.isfinite(best)], keys, key)

    return rows.groupBy(*keys).applyInPandas(compare, schema)


def balls(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _cell, _part, _centre, _radius, _first, _lo): the ball around each block, its earliest row and that row's number."""
    schema = T.StructType([*[rows.schema[c] for c in [*keys, *BLOCK]], T.StructField("_centre", VECTOR), T.StructField("_radius", T.DoubleType()),
                           T.StructField("_first", VECTOR), T.StructField("_lo", T.LongType())])

    def ball(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, at = _matrix(pdf["_x"]), int(pdf["_n"].to_numpy().argmin())
        centre = x.mean(axis=0)
        out = pd.DataFrame({"_centre": [centre], "_radius": [np.linalg.norm(x - centre, axis=1).max()], "_first": [x[at]], "_lo": [pdf["_n"].iloc[at]]})
        return _with_keys(out, [*keys, *BLOCK], key)

    return stored(rows.groupBy(*keys, *BLOCK).applyInPandas(ball, schema), "nearest-balls")


def candidates(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(keys, frame_idx, _n, best, _x, _want, _could) of ``blocks``: the best seen without leaving the own block but for the first
    rows of others, the blocks that may hold a better one, and how many other blocks begin earlier. ``_x`` only where a block is
    wanted. A stream of many blocks has several rows for each, one for every ``block`` balls."""
    held = balls(rows, keys)
    groups = held.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_groups"))
    held = join_on(held, groups, keys).withColumn("_group", F.expr("pmod(hash(_cell, _part), _groups)")).drop("_groups")
    here = rows.select(*keys, *BLOCK).distinct()
    held = join_on(held.withColumnsRenamed({"_cell": "_its_cell", "_part": "_its_part"}), here, keys)
    held = held.toDF(*held.columns)  # columns of its own: both sides of the cogroup come from ``rows``
    left = join_on(rows, groups, keys).withColumn("_group", F.explode(F.expr("sequence(0L, _groups - 1)"))).drop("_groups")
    schema = T.StructType([*[rows.schema[c] for c in [*keys, "frame_idx", "_n"]], T.StructField("best", T.DoubleType()),
                           T.StructField("_x", VECTOR), T.StructField("_cells", T.ArrayType(T.IntegerType())), T.StructField("_parts", T.ArrayType(T.LongType())),
                           T.StructField("_could", T.IntegerType())])

    def bound(key: tuple, own: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(its):
            return pd.DataFrame(columns=schema.names)
        x, n = _matrix(own["_x"]), own["_n"].to_numpy()
        lo, radius, centre = its["_lo"].to_numpy(), its["_radius"].to_numpy(), _matrix(its["_centre"])
        best = np.maximum(_best(x, n, x, n), _best(x, n, _matrix(its["_first"]), lo))
        cell, part = its["_its_cell"].to_numpy(), its["_its_part"].to_numpy()
        other = (cell != key[len(keys)]) | (part != key[len(keys) + 1])
        size, far = np.linalg.norm(x, axis=1)[:, None], radius + 1e-9 * (radius + np.linalg.norm(centre, axis=1))
        wants, n_could = [], []
        for i in range(0, len(x), step := max(1, HELD // len(its))):
            some = slice(i, i + step)
            could = other[None, :] & (lo[None, :] < n[some, None])
            # written so that a bound that is no number rules nothing out
            wanted = could & ~(x[some] @ centre.T + size[some] * far[None, :] <= best[some, None])
            wants += [np.flatnonzero(w).astype(np.int32) for w in wanted]
            n_could.append(could.sum(axis=1).astype("int32"))
        out = pd.DataFrame({
            "frame_idx": own["frame_idx"].to_numpy(), "_n": n, "best": [b if np.isfinite(b) else None for b in best.tolist()],
            "_x": [v if len(w) else None for v, w in zip(x, wants)],
            "_cells": [cell[w].astype(np.int32) for w in wants], "_parts": [part[w].astype(np.int64) for w in wants],
            "_could": np.concatenate(n_could)})
        return _with_keys(out, keys, key)

    by = [*keys, *BLOCK, "_group"]
    seen = left.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(bound, schema)
    want = F.arrays_zip(F.col("_cells").alias("cell"), F.col("_parts").alias("part"))
    return stored(seen.withColumn("_want", want).drop("_cells", "_parts"), "nearest-candidates")


def best_earlier(fired: Laid, block: int = 4096) -> DataFrame:
    """(keys, frame_idx, best_similarity): for every row the best dot product with any earlier row of its stream, exactly.

    Rows visit blocks, so a block's rows are sent as often as ``block`` visitors need it and no pair of rows is produced; what
    stays quadratic is balls against balls, a ``block``-th squared of the rows. Rows without an earlier one, or without an
    embedding, have no answer, and an embedding that is NULL or a product that is no number is nobody's best.
    """
    keys = list(fired.keys)
    if fired.df.groupBy(*keys).count().where(F.col("count") > block).isEmpty():
        return within_streams(numbered(fired), keys)  # nothing to rule out
    rows = blocks(fired, block)
    seen = candidates(rows, keys, block)
    visits = seen.select(*keys, "frame_idx", "_n", "_x", F.explode("_want").alias("_w"))
    visits = visits.select(*keys, "frame_idx", "_n", "_x", F.col("_w.cell").alias("_cell"), F.col("_w.part").alias("_part"))
    by = [*keys, *BLOCK]
    # a block that many visit is sent to several tasks, each with about ``block`` visitors
    shares = stored(visits.groupBy(*by).agg(F.ceil(F.count("*") / block).alias("_shares")), "nearest-shares")
    visits = join_on(visits, shares, by).withColumn("_share", F.expr("pmod(xxhash64(_n), _shares)")).drop("_shares")
    hosts = join_on(rows, shares, by).withColumn("_share", F.explode(F.expr("sequence(0L, _shares - 1)"))).drop("_shares")
    schema = T.StructType([*[rows.schema[c] for c in [*keys, "frame_idx"]], T.StructField("best", T.DoubleType())])

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=schema.names)
        y, at = _matrix(b["_x"]), b["_n"].to_numpy()
        best = np.concatenate([_best(_matrix(some["_x"]), some["_n"].to_numpy(), y, at)
                               for some in (a.iloc[i : i + block] for i in range(0, len(a), block))])
        out = pd.DataFrame({"frame_idx": a["frame_idx"].to_numpy(), "best": best})
        return _with_keys(out[np.isfinite(best)], keys, key)

    hosts = hosts.toDF(*hosts.columns)
    found = visits.groupBy(*by, "_share").cogroup(hosts.groupBy(*by, "_share")).applyInPandas(compare, schema)
    best = seen.select(*keys, "frame_idx", "best").unionByName(found).where("best is not null")
    return best.groupBy(*keys, "frame_idx").agg(F.max("best").alias("best_similarity"))
