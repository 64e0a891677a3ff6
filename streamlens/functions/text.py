"""Text columns used to compare answers. Word = run of ``[a-z0-9']`` in the lower-cased text."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from streamlens.functions.words import STOP_WORDS, WORD

def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def normalise(text: Column) -> Column:
    return F.concat_ws(" ", words(text))


def keep_content(words_col: Column) -> Column:
    """Drop stop words (a hashed set, not a list searched per word) and words of one or two letters."""
    return F.filter(words_col, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def content_words(text: Column) -> Column:
    return keep_content(words(text))


def n_shared(a: Column, b: Column) -> Column:
    """Words that two bags share, each as often as in both: one walk over the words of both in order."""
    tag = lambda ws, side: F.transform(ws, lambda w: F.struct(w.alias("w"), F.lit(side).alias("s")))
    zero = F.lit(0)

    def step(acc: Column, x: Column) -> Column:
        same, in_a, in_b = acc["w"].eqNullSafe(x["w"]), 1 - x["s"], x["s"]
        return F.struct(
            x["w"].alias("w"), F.when(same, acc["a"] + in_a).otherwise(in_a).alias("a"), F.when(same, acc["b"] + in_b).otherwise(in_b).alias("b"),
            F.when(same, acc["n"]).otherwise(acc["n"] + F.least(acc["a"], acc["b"])).alias("n"))

    start = F.struct(F.lit(None).cast("string").alias("w"), zero.alias("a"), zero.alias("b"), zero.alias("n"))
    return F.aggregate(F.array_sort(F.concat(tag(a, 0), tag(b, 1))), start, step, lambda acc: acc["n"] + F.least(acc["a"], acc["b"]))


def bag_f1(a: Column, b: Column) -> Column:
    """F1 of two word bags, 2 * shared / (words of a + words of b): 1 when both are empty, 0 when one is."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * n_shared(a, b) / total)


def is_degenerate(words_col: Column, min_words: int = 3, repeat_ratio: float = 0.5) -> Column:
    """Fewer than ``min_words`` words, or one word making up more than ``repeat_ratio`` of them: the longest run of the sorted
    words says how often the commonest comes."""
    zero = F.lit(0)

    def step(acc: Column, w: Column) -> Column:
        run = F.when(acc["w"].eqNullSafe(w), acc["r"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("w"), run.alias("r"), F.greatest(acc["m"], run).alias("m"))

    start = F.struct(F.lit(None).cast("string").alias("w"), zero.alias("r"), zero.alias("m"))
    top = F.aggregate(F.array_sort(words_col), start, step, lambda acc: acc["m"])
    return F.when(F.size(words_col) < min_words, F.lit(True)).otherwise(F.coalesce(top / F.size(words_col) > repeat_ratio, F.lit(False)))


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of the normalised texts (no Spark built-in measures this)."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(
            [difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64"
        )

    return ratio(normalise(a), normalise(b))


# The patterns of a chosen option and the request that ends a question.
LEADING_OPTION = r"^[^A-Za-z]*([ABCD])\b"
ANY_OPTION = r"\b([ABCD])\b"
LETTER_REQUEST = "Answer with the single letter of the correct option (A, B, C or D) and nothing else."


def option_letter(text: Column) -> Column:
    """First standalone A-D; a letter opening the text wins."""
    head = F.trim(text)
    lead = F.regexp_extract(head, LEADING_OPTION, 1)
    any_ = F.regexp_extract(head, ANY_OPTION, 1)
    return F.coalesce(F.nullif(lead, F.lit("")), F.nullif(any_, F.lit("")))


def clock_seconds(ts: Column) -> Column:
    """``HH:MM:SS`` or ``MM:SS`` (or bare seconds) to seconds; NULL for anything else."""
    p = F.split(F.trim(ts), ":")
    p = F.concat(F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 3 - F.size(p))), p)
    n = [F.element_at(p, i).try_cast("int") for i in (1, 2, 3)]
    return F.when(F.size(p) == 3, (n[0] * 3600 + n[1] * 60 + n[2]).cast("double"))


def choice_prompt(question: Column, options: Column) -> Column:
    return F.concat_ws(
        "\n",
        question,
        F.concat_ws("\n", options),
        F.lit(LETTER_REQUEST),
    )
