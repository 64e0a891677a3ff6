"""Timed multiple-choice questions from CSV."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlens.functions.text import clock_seconds

COLUMNS = "question_id string, task_type string, question string, time_stamp string, answer string, options string, frames_required string, temporal_clue_type string"


def option_list(text: Column) -> Column:
    """List literal -> array; NULL when malformed."""

    @F.pandas_udf("array<string>")
    def parse(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return [str(o) for o in ast.literal_eval(x)]
            except Exception:
                return None

        return s.map(one)

    return parse(text)


def read(spark: SparkSession, path: str) -> DataFrame:
    raw = (
        spark.read.schema(COLUMNS).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
    )
    return parse(raw)


def parse(raw: DataFrame) -> DataFrame:
    """Typed questions; rows whose id or option list does not parse are left out, not guessed."""
    sample, index = (F.regexp_extract("question_id", r"sample_(\d+)_(\d+)", i) for i in (1, 2))
    rows = raw.filter(F.col("question_id").rlike(r"sample_\d+_\d+")).withColumn("options", option_list(F.col("options")))
    return rows.filter("options is not null").select(
        "question_id", sample.cast("long").alias("sample"), index.cast("long").alias("index"), "task_type", "question",
        clock_seconds(F.col("time_stamp")).alias("t"), F.upper(F.substring(F.trim("answer"), 1, 1)).alias("answer"),
        "options", "frames_required", "temporal_clue_type")
