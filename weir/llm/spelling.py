"""Clustering of spellings within a scope, without comparing pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A spelling follows a neighbour that is at least so many times commoner, overall or in the scope.
TIMES = 2


def signatures(text: Column) -> Column:
    """Hashes of a text and of what is left of it without each one of its characters.

    Two texts that differ by a missing, added, changed or swapped character share one of these.
    """
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.xxhash64(F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(text)), shorter))


def cluster_spellings(entries: DataFrame, scope: str, spelling: str, count: str, overall: str, *, least: int = 5) -> DataFrame:
    """(scope, spelling, canonical, others): the commonest spelling that each one leads to in at most three steps.

    entries has a row for each spelling of a scope with its count there and overall; the commonest is the one with the
    largest overall count, then the largest in the scope. Each signature elects its commonest spelling, and each spelling
    follows the commonest that any of its signatures elected, so that work is in proportion to the letters, not
    to pairs. Spellings shorter than `least` or with a digit stand for themselves, as there one character means another
    thing; so do common spellings next to a common one. What counts is how many times commoner the other is, so that the
    same mix of spellings clusters alike at any size.

    others has the other neighbours that the signatures of a spelling elected, the commonest first: at most one for each of
    its letters. For a spelling that stands for itself these are all, commoner or not.
    """
    rows = entries.select(F.col(scope).alias("sc"), F.col(spelling).alias("sp"), F.col(count).alias("n"), F.col(overall).alias("o"))
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fuzzy = rows.filter((F.length("sp") >= least) & ~F.col("sp").rlike("[0-9]")).repartition(tasks, "sc", "sp")  # as each row becomes many
    signed = fuzzy.select("sc", "sp", "n", "o", F.explode(signatures(F.col("sp"))).alias("g"))
    elected = signed.withColumn("best", F.max(F.struct("o", "n", "sp")).over(Window.partitionBy("sc", "g")))  # few spellings share one
    commoner = (F.col("best.o") >= TIMES * F.col("o")) | (F.col("best.n") >= TIMES * F.col("n"))
    # equal hashes of texts that aren't neighbours lead nowhere
    near = (F.col("best.sp") != F.col("sp")) & (F.levenshtein("best.sp", "sp", 2) >= 0)
    led = F.struct(commoner.alias("commoner"), "best.o", "best.n", "best.sp")
    follows = elected.filter(near).groupBy("sc", "sp").agg(F.sort_array(F.collect_set(led), asc=False).alias("led"))
    first = F.when(F.col("led")[0]["commoner"], F.col("led")[0]["sp"])
    rest = F.filter(F.transform("led", lambda b: b["sp"]), lambda s: ~s.eqNullSafe(first))
    step = follows.select("sc", "sp", F.coalesce(first, "sp").alias("to"), rest.alias("others"))
    ahead = step.select("sc", F.col("sp").alias("to"), F.col("to").alias("next"))
    parents = step
    for _ in range(2):
        parents = parents.join(ahead, ["sc", "to"], "left").select("sc", "sp", F.coalesce("next", "to").alias("to"), "others")
    out = rows.select("sc", "sp").join(parents, ["sc", "sp"], "left")
    return out.select(F.col("sc").alias(scope), F.col("sp").alias(spelling), F.coalesce("to", "sp").alias("canonical"), F.coalesce("others", F.array().cast("array<string>")).alias("others"))
