"""User functions on rows: embed every row, answer the rows that fired, or write the requests out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def answer_fired(fired: DataFrame, load: Callable[[], Callable[[pd.DataFrame], list]], keep: list[str]) -> DataFrame:
    """Run a user function over fired rows only. ``load`` runs once per task and returns it.

    A row that fails becomes an ``error``; the job goes on.
    """
    schema = T.StructType([fired.schema[c] for c in keep] + [
        T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = load()
        for pdf in batches:
            answers: list = [None] * len(pdf)
            errors: list = [None] * len(pdf)
            try:
                answers = list(fn(pdf))
            except Exception:  # find the rows to blame, one by one
                for i in range(len(pdf)):
                    try:
                        answers[i] = fn(pdf.iloc[i : i + 1])[0]
                    except Exception as e:
                        errors[i] = f"{type(e).__name__}: {e}"
            yield pdf[keep].assign(answer=answers, error=errors)

    return fired.mapInPandas(run, schema)


def embed(df: DataFrame, load: Callable[[], Callable], column: str, size: int, out: str = "embedding",
          batch_size: int = 256) -> DataFrame:
    """Batch encoder: ``load()`` returns ``numpy batch -> numpy batch`` and is kept per worker.
    ``size`` is the length of the input vectors."""
    from pyspark.ml.functions import predict_batch_udf

    encode = predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[size]])
    return df.withColumn(out, encode(F.col(column)))


def chat_request(prompt: Column, payload: Column, *, payload_first: bool = False, system: str | None = None,
                 max_tokens: int = 32, temperature: float = 0.0, stream: bool = True) -> Column:
    """Chat-completion request of a row as JSON text; part order decides what a server can reuse."""
    part_type = "struct<type:string,text:string,image_url:struct<url:string>>"
    text = F.struct(F.lit("text").alias("type"), prompt.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")).cast(part_type)
    image = F.struct(
        F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
        F.struct(F.concat(F.lit("data:image/jpeg;base64,"), F.translate(payload, "\r\n", "")).alias("url")).alias("image_url")).cast(part_type)
    parts = F.array(image, text) if payload_first else F.array(text, image)
    user = F.to_json(F.struct(F.lit("user").alias("role"), parts.alias("content")))
    messages = user
    if system:
        messages = F.concat(F.to_json(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), F.lit(","), user)
    tail = F.to_json(F.struct(
        F.lit(max_tokens).alias("max_tokens"), F.lit(float(temperature)).alias("temperature"), F.lit(stream).alias("stream")))
    return F.concat(F.lit('{"messages":['), messages, F.lit("],"), F.right(tail, F.length(tail) - 1))
