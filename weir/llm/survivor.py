"""The best representative of each duplicate group, field by field, by token consensus.

The values of a group are aligned token by token, one after the other, into columns; each value votes in every column for
its token or for none; the consensus is what wins each column; and the existing value closest to it survives.

Votes are summed weights. Where the best-ranked value is to decide, as by the rule "the most trusted, then the most recent
value", it would win every column against all others, so that it survives without any alignment.

A group is aligned in cells of at most CELL values, cells' profiles are aligned with each other, CELL at a time, and so
on, so that no task holds a group, however large.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.operators.apply import latest_per_key
from weir.scratch import Scratch

#: Values or profiles that are aligned with each other in one step.
CELL = 256
#: Scores of the alignment: equal tokens, tokens that start alike, different ones, and a token against none.
EQUAL, ALIKE, OTHER, NONE = 2.0, 0.5, -0.6, -0.5

Profile = tuple[object, list[dict[str, object]]]  # what the values in it weigh together, and the votes of each column


def _score(a: dict[str, object], b: dict[str, object]) -> float:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if any(t and t in large for t in small):
        return EQUAL
    heads = {t[:2] for t in large if t}
    return ALIKE if any(t[:2] in heads for t in small if t) else OTHER


def align(a: Profile, b: Profile, add: Callable) -> Profile:
    """The two profiles as one: columns are matched by dynamic programming, and a column without partner gets votes for none."""
    (wa, ca), (wb, cb) = a, b
    if len(ca) == len(cb) and all(x.keys() == y.keys() for x, y in zip(ca, cb)):
        return add(wa, wb), [{t: add(x[t], y[t]) for t in x} for x, y in zip(ca, cb)]
    n, m = len(ca), len(cb)
    best = [[NONE * j for j in range(m + 1)]]
    for i in range(1, n + 1):
        row, above = [NONE * i], best[-1]
        for j in range(1, m + 1):
            row.append(max(above[j - 1] + _score(ca[i - 1], cb[j - 1]), above[j] + NONE, row[-1] + NONE))
        best.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + _score(ca[i - 1], cb[j - 1]):
            i, j = i - 1, j - 1
            column = dict(ca[i])
            for token, vote in cb[j].items():
                column[token] = add(column[token], vote) if token in column else vote
        elif i and best[i][j] == best[i - 1][j] + NONE:
            i -= 1
            column = dict(ca[i])
            column[""] = add(column[""], wb) if "" in column else wb
        else:
            j -= 1
            column = dict(cb[j])
            column[""] = add(column[""], wa) if "" in column else wa
        out.append(column)
    return add(wa, wb), out[::-1]


def consensus(profile: Profile, wins: Callable) -> list[str]:
    """The winning token of each column, without the columns that none wins; ties go to the first token by code point."""
    chosen = []
    for column in profile[1]:
        best = wins(vote for vote in column.values())
        chosen.append(min(t for t, vote in column.items() if vote == best))
    return [t for t in chosen if t]


def distance(a: list[str], b: list[str]) -> int:
    """Tokens to add, drop or change between the two."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _merge(add: Callable, wins: Callable | None = None):
    """Aligns the profiles of each (g, f, cell); rows arrive sorted by cell and rank, and only one profile is held.

    With wins the profile, which is final then, leaves as the tokens of its consensus.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, profile, out = None, None, []
        text_of = json.dumps if wins is None else lambda p: json.dumps(consensus(p, wins))

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1, 2)] + [pa.array([r[3] for r in rows], pa.string())], names=["g", "f", "cell", "profile"])

        for batch in batches:
            for g, f, cell, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                weight, columns = json.loads(text)
                if (g, f, cell) == key:
                    profile = align(profile, (weight, columns), add)
                else:
                    if key is not None:
                        out.append((*key, text_of(profile)))
                    key, profile = (g, f, cell), (weight, columns)
                if len(out) >= 5000:
                    yield batch_of(out)
                    out = []
        if key is not None:
            out.append((*key, text_of(profile)))
        if out:
            yield batch_of(out)

    return merge


def _closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each value the distance of its tokens to its group's consensus."""
    for batch in batches:
        agreed, tokens = batch.column("profile").to_pylist(), batch.column("tokens").to_pylist()
        read = {text: json.loads(text) for text in set(agreed)}
        far = [0 if read[text] == own else distance(own, read[text]) for text, own in zip(agreed, tokens)]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("g", "f", "member", "rank", "value")] + [pa.array(far, pa.int32())], names=["g", "f", "member", "rank", "value", "far"])


def _by_weight(a, b):
    return a + b


def survivors(values: DataFrame, scratch: Scratch, *, tokens: Column, weight: Column | None = None) -> DataFrame:
    """(g, f, member, value): the surviving value of each field f of each group g, and the member that it is from.

    values: g, f, member, value, and rank, a string that sorts the best value first and is unique in a group and field.
    tokens cuts a value into tokens. Without weight the best-ranked value survives; with it the weights of all values are
    summed, and rank only orders the alignment and breaks ties. Values of one token sequence tie.

    Rows with a null in g, f, member, value or rank are left out, as are values without tokens; what says nothing should
    be left out before. A group with a single value keeps it. An empty table gives no rows.
    """
    vote = F.lit(None) if weight is None else weight
    rows = values.select("g", "f", "member", "value", "rank", tokens.alias("tokens"), vote.cast("double").alias("vote")).dropna(subset=["g", "f", "member", "value", "rank"]).filter(F.size("tokens") > 0)
    if weight is None:
        return latest_per_key(rows, ["g", "f"], [F.col("rank"), F.col("member"), F.col("value")]).select("g", "f", "member", "value")
    columns = F.transform("tokens", lambda t: F.create_map(t, F.col("vote")))
    rows = scratch.keep(rows.withColumn("profile", F.concat(F.lit("["), F.to_json(F.array("vote")).substr(F.lit(2), F.length(F.to_json(F.array("vote"))) - 2), F.lit(","), F.to_json(columns), F.lit("]"))))
    sizes = rows.groupBy("g", "f").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).collect()[0][0] or 1  # one number
    depth = 1
    while CELL**depth < most:
        depth += 1
    # nested cells: each level's number of cells divides the one before, and a group of up to CELL values has one
    level = rows.join(sizes, ["g", "f"]).select("g", "f", F.pmod(F.xxhash64("member"), F.lit(CELL ** (depth - 1))).alias("h"), "n", "rank", "profile")
    for step in range(depth):
        cells = CELL ** (depth - 1 - step)
        cell = F.when(F.col("n") <= CELL, F.lit(0)).otherwise(F.pmod("h", F.lit(cells))).cast("string")
        ordered = level.withColumn("cell", cell).repartition("g", "f", "cell").sortWithinPartitions("g", "f", "cell", "rank")
        merged = ordered.select("g", "f", "cell", "profile").mapInArrow(_merge(_by_weight, None if step < depth - 1 else max), "g string, f string, cell string, profile string")
        if step < depth - 1:
            merged = scratch.keep(merged)
            level = merged.join(sizes, ["g", "f"]).select("g", "f", F.col("cell").cast("bigint").alias("h"), "n", F.col("cell").alias("rank"), "profile")
    profiles = merged.select("g", "f", "profile")
    compared = rows.select("g", "f", "member", "rank", "value", "tokens").join(profiles, ["g", "f"])
    far = compared.mapInArrow(_closest, "g string, f string, member string, rank string, value string, far int")
    best = far.groupBy("g", "f").agg(F.min(F.struct("far", "rank", "member", "value")).alias("b"))
    return best.select("g", "f", "b.member", "b.value")
