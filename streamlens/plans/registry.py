"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# -- the adapters of ``streamlens.sources.tables`` in SQL ---------------------------------------
EV = """ev AS (
  SELECT user_id AS stream_id, event_id, epoch_us(ts) AS t_us, epoch_us(ts) / 1e6 AS t, event_type, value FROM events)"""

TR = EV + """,
tr AS (
  SELECT stream_id, t_us, event_id, t, row_number() OVER w - 1 AS frame_idx,
    coalesce(abs(value - lag(value) OVER w) / 500.0, 0.0) AS motion, value / 500.0 AS novelty,
    CAST(0.0 AS DOUBLE) AS scene_change,
    CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 ELSE -1 END AS state_id,
    'user did ' || event_type || ' today v' || CAST(CAST(floor(value / 100) AS INTEGER) AS VARCHAR) AS answer
  FROM ev WINDOW w AS (PARTITION BY stream_id ORDER BY t_us, event_id))"""

FR = """fr AS (
  SELECT vec_id % s.n AS stream_id, vec_id // s.n AS frame_idx, (vec_id // s.n) / 30.0::DOUBLE AS t,
    list_transform(embedding, lambda x: x::DOUBLE) AS e, label AS state_id
  FROM embeddings, (SELECT greatest(10, (count(*) + 99999) // 100000) AS n FROM embeddings) s)"""

DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


def dot(a: str, b: str) -> str:
    return DOT.format(a=a, b=b)


def unit(v: str) -> str:
    n = f"sqrt({dot(v, v)})"
    return f"CASE WHEN {n} > 0 THEN list_transform({v}, lambda x: x / {n}) ELSE {v} END"


def stop_list() -> str:
    from streamlens.functions.words import STOP_WORDS

    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"


def words(t: str) -> str:
    return f"regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9'']+')"


def content(t: str) -> str:
    return f"list_filter({words(t)}, lambda w: len(w) > 2 AND NOT list_contains({stop_list()}, w))"


def f1(a: str, b: str) -> str:
    """F1 of two word-list columns."""
    both = f"""coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda x: x = w))))), 0)"""
    return f"""CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 OR {both} = 0 THEN 0.0
      ELSE 2.0::DOUBLE * ({both}::DOUBLE / len({a})) * ({both}::DOUBLE / len({b})) / ({both}::DOUBLE / len({a}) + {both}::DOUBLE / len({b})) END"""


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {digits}) AS {name}"


def lng(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"
