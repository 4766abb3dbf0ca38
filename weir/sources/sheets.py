"""Sheets that people keep: columns found by patterns, and which rows are fit to import."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.operators.apply import validated


def columns_by_pattern(columns: Sequence[str], patterns: Mapping[str, str]) -> dict[str, str]:
    """The first column whose header matches each pattern, white space and case aside; what matches none is left out."""
    clean = {c: re.sub(r"\s+", " ", c.lstrip("\ufeff")).strip() for c in columns}
    found = {name: next((c for c, header in clean.items() if re.search(pattern, header, re.IGNORECASE)), None) for name, pattern in patterns.items()}
    return {name: c for name, c in found.items() if c}


def qualified(df: DataFrame, row: str, key: str, *, excluded: Mapping[str, Sequence[str]], words: Sequence[str] = (), done: Column | None = None) -> DataFrame:
    """df with the key's digits, and reason, null where a row is fit: invalid, excluded, done, or duplicate.

    excluded has values of columns that shut a row out, words are ones that do so anywhere in it. Of the fit rows of a key
    the first by `row` stays.
    """
    digits = F.regexp_replace(F.coalesce(F.col(key).cast("string"), F.lit("")), r"\D", "")
    text = F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in df.columns]))
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    out = F.lit(False)
    for column, values in excluded.items():
        out = out | low(column).isin(*[v.strip().lower() for v in values])
    for word in words:
        out = out | text.contains(word.strip().lower())
    rules = [("invalid", F.length(key) != 10), ("excluded", F.col("__out")), ("done", F.col("__done"))]
    marked = df.withColumn("__out", out).withColumn("__done", F.coalesce(done, F.lit(False)) if done is not None else F.lit(False)).withColumn(key, digits)
    return validated(marked, key, row, rules, []).drop("__out", "__done")
