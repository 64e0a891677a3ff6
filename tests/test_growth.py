"""Steps whose rows or memory must not grow faster than their input."""

import numpy as np
import oracle
import pytest

import __spark_entry__ as entry
from streamlens.operators import nearest


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def held_as(spark, folder, name, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/tmp")
    (part,) = folder.glob("tmp/part-*.parquet")
    part.rename(folder / f"{name}.parquet")
    return str(folder)


def test_bags_of_turns_are_compared_in_their_row(spark, tmp_path):
    rows = [(1, 0, "user", "A b b c, c c"), (1, 1, "user", "b B c d'e"), (1, 2, "user", "..."), (1, 3, "user", ""), (1, 4, "user", "b"), (1, 5, "user", None),
            (1, 6, "user", "x x"), (2, 0, "user", "alone"), (3, 0, "user", None), (3, 1, "user", None)]
    path = held_as(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    df = entry.queries()["i3_bag_intersection"](spark, path)
    assert "Generate" not in plan(df)  # no row for each word
    assert oracle.compare(df, oracle.connect(path), entry.oracle_sql()["i3_bag_intersection"]) is None


def test_long_texts_are_compared_in_their_row(spark, tmp_path):
    texts = ["alpha beta beta gamma the of", "beta beta beta delta", "the of", "", None, "omega " * 3000, "omega sigma " * 2000, None, None]
    path = held_as(spark, tmp_path, "documents", [(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df = entry.queries()["b9_long_text_f1"](spark, path)
    assert "Generate" not in plan(df)
    assert oracle.compare(df, oracle.connect(path), entry.oracle_sql()["b9_long_text_f1"]) is None
