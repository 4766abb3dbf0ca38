"""Consolidating pairwise matches into groups, over an edge table of any size.

1. The giant component is peeled: breadth-first joins walk from the vertex of highest degree, a frontier at a time, while
   the frontiers still make up a fair part of what was reached. The vertices behind the last frontier are anti-joined
   away; none of them touches a vertex that wasn't reached.
2. The remaining small components, and what hangs on the last frontier, are labelled by minimum propagation: each vertex
   takes the least of itself and its neighbours, least vertices are followed towards their ends by doubling, and vertices
   contract onto them, until no edge is left. The last end of a vertex is the least vertex of its component.
3. A component that holds a vertex of the last frontier belongs to the giant.

Each step is a written table in the shared folder, so that lost executors cost only their own tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.scratch import Scratch

#: A frontier below this share of the vertices reached ends the peeling, so that a long tail of the giant doesn't cost a
#: join a step; minimum propagation labels what hangs on it.
FRONTIER_SHARE = 0.05
#: Chains that are followed further while more than this share of the vertices is still on the way; the rest goes on after the contraction.
MOVING_SHARE = 0.02


def star_links(members: DataFrame, group: str, vertex: str, spread: int = 64) -> DataFrame:
    """(a, b) links that connect the vertices of each group, one less than it has.

    Members link to the least of their cell, and the cells' least members to the group's; cells spread a group that
    holds a third of all rows over `spread` tasks. Nulls and blanks are left out; repeated rows count once.
    """
    rows = members.select(F.col(group).alias("g"), F.trim(F.col(vertex)).alias("v")).filter("g is not null and v is not null and v != ''").distinct()
    cells = rows.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(spread))).withColumn("m", F.min("v").over(Window.partitionBy("g", "s")))
    tops = cells.filter("v = m").withColumn("t", F.min("v").over(Window.partitionBy("g")))
    return cells.filter("v != m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(tops.filter("v != t").select(F.col("t").alias("a"), F.col("v").alias("b")))


def pair_links(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(a, b) links of a table of pairs; rows with a null or blank side and pairs of one vertex link nothing."""
    return pairs.select(F.trim(F.col(left)).alias("a"), F.trim(F.col(right)).alias("b")).filter("a != '' and b != '' and a != b")


def _peel(edges: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], int]:
    """The levels reached from the vertex of highest degree, as written tables, and the size of the last, which may be 0."""
    top = edges.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1).collect()  # one row
    if not top:
        return [], 0
    last, size = scratch.keep_counted(edges.sparkSession.createDataFrame([(top[0]["src"],)], "v string"))
    levels, total = [last], size
    while size and (len(levels) == 1 or size >= FRONTIER_SHARE * total):
        # neighbours of a frontier are in it, in the one before, or new
        new = edges.join(last.withColumnRenamed("v", "src"), "src", "left_semi").select(F.col("dst").alias("v")).distinct()
        for known in levels[-2:]:
            new = new.join(known, "v", "left_anti")
        last, size = scratch.keep_counted(new)
        total += size
        levels.append(last)
    return levels, size


def _least_ends(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, p): the end of each vertex's chain of least neighbours, for nearly all. A step follows four pointers of the one before."""
    least = edges.groupBy("src").agg(F.min("dst").alias("n"))
    pointers, size = scratch.keep_counted(least.select(F.col("src").alias("v"), F.least("n", "src").alias("p")))
    moved = size
    while moved > MOVING_SHARE * size:
        on = lambda a, b: pointers.select(F.col("v").alias(a), F.col("p").alias(b))
        ahead = pointers.join(on("p", "q"), "p").join(on("q", "r"), "q").join(on("r", "s"), "r")
        further, moved = scratch.keep_counted(ahead.select("v", F.col("s").alias("p"), (F.col("s") != F.col("r")).alias("moved")), F.col("moved"))
        scratch.drop(pointers)
        pointers = further.select("v", "p")
        pointers._weir_path = further._weir_path  # noqa: SLF001
    return pointers


def _contract(edges: DataFrame, pointers: DataFrame) -> DataFrame:
    """Edges between the pointers' targets, without those inside one."""
    to = lambda side: pointers.select(F.col("v").alias(side), F.col("p").alias(f"new_{side}"))
    new = edges.join(to("src"), "src").join(to("dst"), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
    return new.filter("src != dst").distinct()


def least_labels(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(v, p): each vertex of edges, which run both ways, with the least vertex of its component; None without edges.

    A contraction keeps the local minima only, which are at most half of the vertices of a component that isn't a star
    around its largest vertex, and that one is settled in the round after. A sorted string of n records takes one round of
    about log n steps. edges is dropped from scratch.
    """
    turns: list[DataFrame] = []
    left = 1
    while left:
        pointers = _least_ends(edges, scratch)
        contracted, left = scratch.keep_counted(_contract(edges, pointers))
        scratch.drop(edges)
        edges = contracted
        turns.append(pointers)
    # each round's vertices are targets of the round before, so that labels follow from the last round backwards
    labels = turns.pop()
    for pointers in reversed(turns):
        later = labels.select(F.col("v").alias("p"), F.col("p").alias("q"))
        labels = pointers.join(later, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
    return labels


def connected_sets(links: DataFrame, label: str = "components") -> DataFrame:
    """(vertex, group): each vertex of links (a, b) with the smallest vertex (by code point) that any number of links reaches.

    Links may repeat, run either way, or lead from a vertex to itself; the latter link nothing. Rows with a null link
    nothing. A vertex without a link to another has no row. No links give no rows.

    A vertex that a third of all links touch is reduced by partial aggregation where neighbours are compared, and joins
    on it are left to the skew handling of adaptive execution; if it is the one of highest degree it is peeled first.
    The giant, which may hold most vertices, gets its group from an aggregate, without a join on its label.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, label)
    one = links.select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst")).filter("src is not null and dst is not null and src != dst")
    edges = scratch.keep(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    levels, rim = _peel(edges, scratch)
    if not levels:
        return spark.createDataFrame([], "vertex string, `group` string")
    inner = reduce(DataFrame.unionByName, levels[:-1])
    away = lambda side: inner.withColumnRenamed("v", side)
    rest, left = scratch.keep_counted(edges.join(away("src"), "src", "left_anti").join(away("dst"), "dst", "left_anti"))
    scratch.drop(edges)
    giant = reduce(DataFrame.unionByName, levels)
    apart = None
    if left:
        apart = least_labels(rest, scratch)
        if rim:  # what hangs on the last frontier is of the giant
            apart = scratch.keep(apart)
            hanging = apart.join(levels[-1], "v", "left_semi").select("p").distinct()
            giant = giant.unionByName(apart.join(hanging, "p", "left_semi").select("v")).distinct()
            apart = apart.join(hanging, "p", "left_anti")
    least = giant.agg(F.min("v").alias("m")).collect()[0]["m"]  # one value
    found = giant.select(F.col("v").alias("vertex"), F.lit(least).alias("group"))
    return found if apart is None else found.unionByName(apart.select(F.col("v").alias("vertex"), F.col("p").alias("group")))
