"""Column expressions over texts, words and sorted positions (no Python on the executors)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def space_words(text: Column) -> Column:
    """Words between white space (bytes 20, 09 to 0D); null text: none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def ascii_words(text: Column) -> Column:
    """Words of the ASCII letters and digits and all characters beyond ASCII, A-Z lower-cased; null text: none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def union_length(spans: Column, start: str, length: str) -> Column:
    """How many places an array of structs (start, length), sorted by start, covers."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(acc: Column, x: Column) -> Column:
        end = (x[start] + x[length]).cast("long")
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x[start].cast("long")))).cast("long").alias("n"),
            F.greatest(acc["end"], end).alias("end"),
        )

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])
