"""Ordered layout of a table: per-key order that still splits a key holding much of the data.

Every ordered operator (lag, carry-forward, running sum, fold) runs over the partition columns
``keys + [_chunk]``. For keys of ordinary size there is no chunk column and the operators are plain
window functions. When a key holds more than ``spark.streamlens.chunkRows`` rows, its rows are cut
into time-contiguous chunks of about that size and what crosses a chunk border (the previous row, the
last non-null value, the sum so far) travels through a table with one row per chunk.

Sizes are measured with one column-pruned aggregate each time a table is laid out. Chunks are the ranges of a
range exchange over the key's full order, so neither a far-off time nor a burst nor tied times leave a chunk
large, and no row ever meets a list of borders, however many chunks a key has. A
NULL key is a key like any other: everything that crosses a border is joined null-safely.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from streamlens.session import cut_lineage, stored

CHUNK = "_chunk"


def chunk_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.streamlens.chunkRows", "4000000"))


@dataclass(frozen=True)
class Laid:
    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    # -- shape ---------------------------------------------------------------------------
    @property
    def parts(self) -> list[str]:
        return [*self.keys, CHUNK] if self.split else list(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*[F.col(c) for c in self.parts]).orderBy(*self.order)

    def so_far(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def with_df(self, df: DataFrame) -> Laid:
        return replace(self, df=df)

    def transform(self, fn) -> Laid:
        return replace(self, df=fn(self.df))

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK) if self.split else self.df

    # -- carried columns -----------------------------------------------------------------
    def _carry(self, aggs: dict[str, Column], over: dict[str, Column], prefix: str) -> DataFrame:
        """One row per chunk of a split key: ``over`` evaluated on ``aggs`` of the earlier chunks.

        Written out, so that a chain of carries stays a chain: each would otherwise be computed again
        inside every later one.
        """
        per_chunk = (
            self.df.filter(F.col(CHUNK) >= 0)
            .groupBy(*self.parts)
            .agg(*[c.alias(n) for n, c in aggs.items()])
        )
        return cut_lineage(per_chunk.select(*self.parts, *[c.alias(prefix + n) for n, c in over.items()]))

    def _before(self) -> WindowSpec:
        return (
            Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        )

    def _order_key(self) -> Column:
        return F.struct(*self.order)

    def lag(self, **cols: Column | str) -> Laid:
        """Value of the previous row of the key; NULL on its first row."""
        cols = {n: F.col(c) if isinstance(c, str) else c for n, c in cols.items()}
        w = self.window()
        if not self.split:
            return self.transform(
                lambda d: d.withColumns({n: F.lag(c).over(w) for n, c in cols.items()})
            )
        carry = self._carry(
            {n: F.max_by(F.struct(c.alias("v")), self._order_key()) for n, c in cols.items()},
            {n: F.last(F.col(n), ignorenulls=True).over(self._before())["v"] for n in cols},
            "_c_",
        )
        df = join_on(self.df, carry, self.parts, "left")
        first = F.row_number().over(w) == 1
        df = df.withColumns(
            {n: F.when(first, F.col("_c_" + n)).otherwise(F.lag(c).over(w)) for n, c in cols.items()}
        )
        return self.with_df(df.drop(*["_c_" + n for n in cols]))

    def last(self, **cols: Column | str) -> Laid:
        """Latest non-null value up to and including the row."""
        cols = {n: F.col(c) if isinstance(c, str) else c for n, c in cols.items()}
        w = self.so_far()
        if not self.split:
            return self.transform(
                lambda d: d.withColumns({n: F.last(c, True).over(w) for n, c in cols.items()})
            )
        carry = self._carry(
            {
                n: F.max_by(c, F.when(c.isNotNull(), self._order_key()))
                for n, c in cols.items()
            },
            {n: F.last(F.col(n), ignorenulls=True).over(self._before()) for n in cols},
            "_c_",
        )
        df = join_on(self.df, carry, self.parts, "left").withColumns(
            {n: F.coalesce(F.last(c, True).over(w), F.col("_c_" + n)) for n, c in cols.items()}
        )
        return self.with_df(df.drop(*["_c_" + n for n in cols]))

    def running(self, **cols: Column | str) -> Laid:
        """Running sum up to and including the row (NULLs add nothing)."""
        cols = {n: F.col(c) if isinstance(c, str) else c for n, c in cols.items()}
        w = self.so_far()
        if not self.split:
            return self.transform(
                lambda d: d.withColumns({n: F.sum(c).over(w) for n, c in cols.items()})
            )
        carry = self._carry(
            {n: F.sum(c) for n, c in cols.items()},
            {n: F.sum(n).over(self._before()) for n in cols},
            "_c_",
        )
        df = join_on(self.df, carry, self.parts, "left")
        out = {}
        for n, c in cols.items():
            here, earlier = F.sum(c).over(w), F.col("_c_" + n)
            out[n] = F.when(here.isNull(), earlier).when(earlier.isNull(), here).otherwise(here + earlier)
        return self.with_df(df.withColumns(out).drop(*["_c_" + n for n in cols]))

    def row_number(self, name: str) -> Laid:
        """0-based position of the row within its key."""
        return self.running(**{name: F.lit(1).cast("long")}).transform(
            lambda d: d.withColumn(name, F.col(name) - 1)
        )

    def head_of_next(self, name: str, value: Column, n: int) -> Laid:
        """First ``n`` values of the rows following the chunk (only split keys have any)."""
        if not self.split:
            return self.transform(lambda d: d.withColumn(name, F.array().cast("array<double>")))
        rank = F.row_number().over(self.window())
        heads = (
            self.df.filter(F.col(CHUNK) >= 0)
            .select(*self.parts, rank.alias("_r"), value.alias("_v"))
            .filter(F.col("_r") <= n)
            .groupBy(*self.parts)
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]).alias("_h"))
        )
        after = Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(1, n)
        heads = heads.select(
            *self.parts, F.slice(F.flatten(F.collect_list("_h").over(after)), 1, n).alias(name)
        )
        return self.with_df(join_on(self.df, cut_lineage(heads), self.parts, "left"))


def lay_out(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    within: Laid | None = None,
    target_rows: int | None = None,
) -> Laid:
    """Describe ``df`` as ordered by ``order`` inside ``keys``; split keys that are too large.

    ``within``: a layout whose groups contain the groups of this one (a filtered, aggregated or
    more finely keyed version of the same rows). If that one needed no split, neither does this.
    """
    keys, order = tuple(keys), tuple(order)
    df = df.drop(CHUNK)
    if within is not None and not within.split:
        return Laid(df, keys, order, False)
    target = target_rows or chunk_rows(df)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > target)
    big = stored(sizes, "large-keys")
    n_chunks = big.agg(F.sum(F.ceil(F.col("_n") / F.lit(target)))).first()[0]
    if not n_chunks:
        return Laid(df, keys, order, False)

    # A range exchange of the large keys' rows by (key, order) deals them out evenly whatever the spacing, and the range that a
    # row lands in is its chunk: contiguous in the order, and only rows equal in all of it stay together. The rows are written
    # as they were dealt, so every later reader sees one and the same cut.
    hot = big.drop("_n")
    large = join_on(df, hot, keys, "left_semi") if keys else df
    dealt = stored(large.repartitionByRange(int(n_chunks), *keys, *order).withColumn(CHUNK, F.spark_partition_id().cast("long")), "chunks")
    if not keys:
        return Laid(dealt, keys, order, True)
    rest = join_on(df, hot, keys, "left_anti").withColumn(CHUNK, F.lit(-1).cast("long"))
    return Laid(rest.unionByName(dealt), keys, order, True)


def join_on(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of both sides in which NULL equals NULL; the left side's columns are kept. Other columns of the
    two sides must differ in name."""
    on = list(on)
    right = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    out = left.join(right, match, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_on_{c}" for c in on])
