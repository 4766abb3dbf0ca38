"""Records related by a shared key, name audits, and the few rules that no built-in expresses."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.scratch import Scratch


def with_key_size(df: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """df with how many rows share its keys; null where a key is. An aggregate and a join, so that a frequent key isn't one task."""
    counted = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias(size))
    return df.join(counted, list(keys), "left")


def related(df: DataFrame, id: str, rules: dict[str, tuple[Sequence[str], int]], top: int = 3, first: DataFrame | None = None) -> DataFrame:
    """(id, other, why): up to `top` others of each record that share a rule's keys, the most reasons first, then the smallest id.

    With first, a table of ids, its records go before all others.

    A rule only pairs keys of at most its cap of records, as a key of many means nothing; that bounds its pairs by cap
    times the records. Nulls are no key.
    """
    found: DataFrame | None = None
    for why, (keys, cap) in rules.items():
        rows = df.select(id, *keys).dropna().distinct()
        counted = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n").between(2, cap)).drop("__n")
        small = rows.join(counted, list(keys))
        pairs = small.join(small.withColumnRenamed(id, "other"), list(keys)).filter(F.col(id) != F.col("other")).select(id, "other", F.lit(why).alias("why"))
        found = pairs if found is None else found.unionByName(pairs)
    merged = found.groupBy(id, "other").agg(F.array_join(F.sort_array(F.collect_set("why")), "+").alias("why"), F.countDistinct("why").alias("n"))
    if first is not None:
        merged = merged.join(first.select(F.col(first.columns[0]).alias("other"), F.lit(1).alias("__first")).dropna().distinct(), "other", "left")
    order = [F.desc("n"), F.asc("other")] if first is None else [F.desc_nulls_last("__first"), F.desc("n"), F.asc("other")]
    best = Window.partitionBy(id).orderBy(*order)  # at most the sum of the caps in a partition
    return merged.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top).select(id, "other", "why")


def clusters(df: DataFrame, id: str, rules: Sequence[tuple[Sequence[str], int]]) -> DataFrame:
    """(id, branch): records that share the keys of a rule through any number of others; a key of more than its cap says nothing."""
    keyed = df
    for i, (keys, cap) in enumerate(rules):
        distinct = df.select(id, *keys).dropna().distinct().groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n").between(2, cap))
        small = distinct.select(*keys, F.concat_ws("|", *keys).alias(f"__k{i}"))
        keyed = keyed.join(small, list(keys), "left")
    return branches_merged(keyed.select(id, *[f"__k{i}" for i in range(len(rules))]), [[f"__k{i}"] for i in range(len(rules))], id)


def most_common(df: DataFrame, by: Sequence[str], value: str, count: str = "n") -> DataFrame:
    """(by, value, count): the most frequent value of each group, the smallest among equals; nulls don't count."""
    counted = df.dropna(subset=[value]).groupBy(*by, value).agg(F.count("*").alias("__times"))
    best = counted.groupBy(*by).agg(F.min(F.struct((-F.col("__times")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(*by, F.col("b.v").alias(value), (-F.col("b.m")).alias(count))


def ranked_candidates(pairs: DataFrame, lead: Sequence[str], flags: Sequence[Column], candidate: str) -> DataFrame:
    """pairs with `agreed`, the number of flags that hold, and `rank` among the lead's candidates: most agreement, then smallest id."""
    agreed = sum((F.when(f, 1).otherwise(0) for f in flags), F.lit(0))
    scored = pairs.withColumn("agreed", agreed)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*lead).orderBy(F.desc("agreed"), candidate)))


def _longest_common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts from 0 to 100: twice the longest common subsequence of their sorted words over both lengths.

    Null if either is; 100 for two empty ones. For pairs that a join has already blocked, as it costs the product of the
    lengths.
    """
    return F.pandas_udf(_ratios, T.IntegerType())(a, b)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        if x is None or y is None or x != x or y != y:
            out.append(None)
            continue
        p, q = " ".join(sorted(x.lower().split())), " ".join(sorted(y.lower().split()))
        out.append(100 if not p and not q else int(200 * _longest_common(p, q) / (len(p) + len(q)) + 0.5))
    return pd.Series(out, dtype="Int32")


def group_pages(df: DataFrame, scope: str, group: str, order: Sequence[str], size: int) -> DataFrame:
    """(scope, group, page): whole groups in order, a new page as soon as one has at least `size` rows.

    A running sum that starts anew isn't a window; each scope's groups (a page list, not rows) are folded in order by a
    mapped function that holds two numbers.
    """
    groups = df.groupBy(scope, group).agg(F.count("*").alias("n"), *[F.min(c).alias(f"o{i}") for i, c in enumerate(order)])
    kind = groups.schema[group].dataType.simpleString()
    ordered = groups.repartition(scope).sortWithinPartitions(scope, *[f"o{i}" for i in range(len(order))], group).select(F.col(scope).cast("string").alias("s"), F.col(group).alias("g"), "n")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, page, filled = None, 0, 0
        for frame in frames:
            pages = []
            for s, n in zip(frame["s"], frame["n"]):
                if s != at:
                    at, page, filled = s, 0, 0
                elif filled >= size:
                    page, filled = page + 1, 0
                filled += n
                pages.append(page)
            yield pd.DataFrame({"s": frame["s"], "g": frame["g"], "page": pages})

    return ordered.mapInPandas(fold, f"s string, g {kind}, page int").select(F.col("s").alias(scope), F.col("g").alias(group), "page")


def _of_shared_keys(members: DataFrame) -> DataFrame:
    """Members (k, v) of keys that more than one record has, with the key's least record m."""
    leaders = members.groupBy("k").agg(F.min("v").alias("m"), F.max("v").alias("most")).filter("m != most").select("k", "m")
    return members.join(leaders, "k")


def branches_merged(df: DataFrame, rules: Sequence[Sequence[str]], id: str) -> DataFrame:
    """(id, branch): each id with the smallest id of its branch; records that share all keys of any one rule are in one branch.

    A branch goes on through any number of records and rules, in whatever order they come. A rule with a null among its
    keys says nothing of that row. Rows of one id add their keys together; the id has one row in the result.

    The members of a key point to its least record, pointers are followed to their ends in steps that double, and records
    contract onto those, until no key has two. Each step is a written table. A frequent key is reduced by an aggregate
    before the shuffle; joins on it are left to adaptive skew handling.
    """
    scratch = Scratch(df.sparkSession, "branches")
    rows = scratch.keep(df.select(id, *dict.fromkeys(k for keys in rules for k in keys)).distinct())
    keyed = [
        rows.dropna(subset=[id, *keys]).select(F.array(F.lit(str(i)), *[F.col(k).cast("string") for k in keys]).alias("k"), F.col(id).alias("v")) for i, keys in enumerate(rules)
    ]
    linked, labels = scratch.keep(_of_shared_keys(reduce(DataFrame.unionByName, keyed).distinct())), None
    while not linked.isEmpty():
        pointers = scratch.keep(linked.groupBy("v").agg(F.min("m").alias("p")))
        onward = pointers.select(F.col("v").alias("p"), F.col("p").alias("q"))
        while not onward.join(pointers.select(F.col("v").alias("q"), F.col("p").alias("r")), "q").filter("q != r").isEmpty():
            further = scratch.keep(pointers.join(onward, "p").select("v", F.col("q").alias("p")))
            scratch.drop(pointers)
            pointers = further
            onward = pointers.select(F.col("v").alias("p"), F.col("p").alias("q"))
        contracted = scratch.keep(_of_shared_keys(linked.join(pointers, "v").select("k", F.col("p").alias("v")).distinct()))
        scratch.drop(linked)
        linked = contracted
        # later rounds only move what the first ones point to
        labels = pointers if labels is None else labels.join(onward, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
    ids = rows.select(id).distinct()
    if labels is None:
        return ids.withColumn("branch", F.col(id))
    return ids.join(labels.select(F.col("v").alias(id), F.col("p").alias("branch")), id, "left").select(id, F.coalesce("branch", id).alias("branch"))
