"""Filling containers of fixed capacity with items of varying length.

The global histogram of lengths, which has as many bins as the capacity has units, is all the planner sees. Dynamic
programming splits it into buckets of least padding. Inside each bucket, batches of at most the capacity form from the
bucket's own items. As batches of long items leave room that no item of their bucket fits, the shortest buckets, as few as
hold what the others lack, don't keep their batches but fill that room; closing may be turned off. The plan lists, for each
length, runs of ranks and the containers that they go to, so that items only need their rank among those of equal length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def length_buckets(histogram: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length buckets that minimise padding; histogram[n] items have length n.

    Padding is what items lack to their bucket's bound. best[j] is the least padding of all lengths up to j; each round
    of the recurrence allows one bucket more. A bucket's lower end never moves back as its upper end grows, so that each
    half of the ends is searched inside what its middle found: n log n steps a round, in memory of n.
    """
    used = np.flatnonzero(histogram)
    if not len(used):
        return []
    size = len(histogram)
    bounds = np.concatenate([[0], used])  # only lengths that occur can bound a bucket
    m = np.cumsum(histogram, dtype=np.float64)[bounds]
    t = np.cumsum(histogram * np.arange(size), dtype=np.float64)[bounds]
    n = len(bounds)
    best, choices = bounds * m - t, []  # one bucket
    for _ in range(min(buckets, n - 1) - 1):
        after, before = np.zeros(n), np.zeros(n, np.int64)
        halves = [(1, n - 1, 0, n - 2)]
        while halves:
            low, high, first, last = halves.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            padding = best[i] + bounds[j] * (m[j] - m[i]) - (t[j] - t[i])
            k = int(padding.argmin())
            after[j], before[j] = padding[k], i[k]
            halves += [(low, j - 1, first, int(i[k])), (j + 1, high, int(i[k]), last)]
        choices.append(before)
        best = after
    at, out = n - 1, []
    for before in reversed(choices):
        out.append(int(bounds[at]))
        at = int(before[at])
        if at == 0:
            break
    if at:
        out.append(int(bounds[at]))
    return out[::-1]


Batch = tuple[dict[int, int], int, int]  # how many items of which length, how many such containers, the bucket's bound


def _longest_fit(left: np.ndarray, room: int, low: int, high: int) -> dict[int, int]:
    """What longest-fit takes of the lengths from above low to high: the longest that fits, until none does."""
    content, length = {}, min(high, room)
    while length > low:
        fits = min(room // length, int(left[length]))
        if fits:
            content[length] = fits
            room -= fits * length
        length = min(length - 1, room)
    return content


def _batches(left: np.ndarray, capacity: int, low: int, high: int, bound: int) -> list[Batch]:
    """Batches of the lengths from above low to high, which are used up: as many equal ones at once as there are."""
    out = []
    for longest in range(high, low, -1):
        while left[longest]:
            content = _longest_fit(left, capacity, low, longest)
            times = min(int(left[n]) // k for n, k in content.items())
            for n, k in content.items():
                left[n] -= k * times
            out.append((content, times, bound))
    return out


def plan_batches(histogram: np.ndarray, capacity: int, bounds: list[int], close: bool = True) -> list[Batch]:
    """The batches of all items: formed inside the buckets, then closed with items of the shortest ones.

    Buckets are taken from the longest down. Those that keep their batches leave room; the others, the fewest shortest
    ones that hold at least as much, fill it by longest-fit, and batches of their own form from what is left of them.
    """
    left = histogram.astype(np.int64).copy()
    spans = list(zip([0, *bounds], bounds))
    inside = [_batches(left, capacity, low, high, high) for low, high in spans]
    if not close:
        return [b for batches in reversed(inside) for b in batches]
    tokens = lambda batch: sum(n * k for n, k in batch[0].items())
    held = [sum(tokens(b) * b[1] for b in batches) for batches in inside]
    lacking = [sum((capacity - tokens(b)) * b[1] for b in batches) for batches in inside]
    fillers = next(s for s in range(len(spans) + 1) if sum(held[:s]) >= sum(lacking[s:]))
    top = bounds[fillers - 1] if fillers else 0
    left[: top + 1] = histogram[: top + 1]
    out = []
    for content, times, bound in [b for batches in reversed(inside[fillers:]) for b in batches]:
        room = capacity - sum(n * k for n, k in content.items())
        while times:
            more = _longest_fit(left, room, 0, top)
            some = min([times, *(int(left[n]) // k for n, k in more.items())])
            for n, k in more.items():
                left[n] -= k * some
            out.append((content | more, some, bound))
            times -= some
    bound_of = np.repeat(bounds, [high - low for low, high in spans])
    return out + [(content, times, int(bound_of[max(content) - 1])) for content, times, _ in _batches(left, capacity, 0, top, top)]


def plan_containers(histogram: np.ndarray, capacity: int, bounds: list[int], close: bool = True) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, container, items a container, bucket bound) for all items, and the number of containers.

    A batch uses up a length, or another batch's room, so that there are about as many runs as lengths.
    """
    given = np.zeros(len(histogram), np.int64)
    runs, made = [], 0
    for content, times, bound in plan_batches(histogram, capacity, bounds, close):
        for n, k in content.items():
            runs.append((n, given[n], made, k, bound))
            given[n] += k * times
        made += times
    return np.array(runs, np.int64).reshape(-1, 5), made


def items_of(lengths: DataFrame, key: str, length: str, capacity: int) -> DataFrame:
    """(key, part, start, size): each item, one longer than the capacity in parts of that size and a rest; none without length."""
    parts = F.sequence(F.lit(0), F.expr(f"cast((`{length}` - 1) div {capacity} as int)"))
    rows = lengths.filter(F.col(length) > 0).select(F.col(key), F.col(length).cast("int").alias("__n"), F.explode(parts).alias("part"))
    start = F.col("part") * capacity
    return rows.select(key, "part", start.alias("start"), F.least(F.lit(capacity), F.col("__n") - start).alias("size"))


def ranked_by_size(items: DataFrame, key: str, spread: int) -> DataFrame:
    """items with their rank (from 0) among those of equal size, without collecting a size in one task.

    Each size is spread over `spread` cells by a hash of the item; ranks are taken inside a cell and shifted by the items
    in the cells before, of which there are at most capacity times spread.
    """
    cells = items.withColumn("__cell", F.pmod(F.xxhash64(key, "part"), F.lit(spread)).cast("int"))
    ranked = cells.withColumn("__r", F.row_number().over(Window.partitionBy("size", "__cell").orderBy(key, "part")))
    before = F.sum("__n").over(Window.partitionBy("size").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.groupBy("size", "__cell").agg(F.count("*").alias("__n")).select("size", "__cell", F.coalesce(before, F.lit(0)).alias("__before"))
    return ranked.join(offsets, ["size", "__cell"]).withColumn("rank", F.col("__before") + F.col("__r") - 1).drop("__cell", "__r", "__before")


def _place(runs: np.ndarray):
    """Looks up the run of (size, rank) and adds container and bucket."""
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    first_of = np.searchsorted(runs[:, 0], np.arange(runs[:, 0].max() + 2) if len(runs) else np.zeros(1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            low, high = first_of[size], first_of[size + 1]
            while (high - low > 1).any():  # bisection inside each size's runs, for all rows at once
                middle = (low + high) // 2
                right = (high - low > 1) & (runs[middle % len(runs), 1] <= rank)
                low, high = np.where(right, middle, low), np.where(right | (high - low <= 1), high, middle)
            run = runs[low]
            container = run[:, 2] + (rank - run[:, 1]) // run[:, 3]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(container, pa.int64()), pa.array(run[:, 4].astype(np.int32))], names=[*names, "container_id", "bucket"]
            )

    return place


def histogram_of(items: DataFrame, capacity: int) -> np.ndarray:
    """Items of each size; at most `capacity` rows reach the driver."""
    histogram = np.zeros(capacity + 1, np.int64)
    for row in items.groupBy("size").count().collect():
        histogram[row["size"]] = row["count"]
    return histogram


def pack(items: DataFrame, key: str, capacity: int, *, buckets: int = 32, spread: int | None = None, close: bool = True) -> DataFrame:
    """(key, part, start, size, container_id, bucket): the container of every item of items_of.

    items are read three times (histogram, cells, ranks), so that they should be a written table. The plan has a few
    runs for each length, which bounds what the tasks get, whatever the number of items. bucket is the bound of the bucket
    that the container's longest item, and the batch it was opened for, is of. With close=False each container holds items
    of its own bucket only. Containers are numbered from 0 without gaps, and none is over its capacity. Repeated keys are
    items of their own; an empty table gives no rows.
    """
    spark = items.sparkSession
    histogram = histogram_of(items, capacity)
    runs, _ = plan_containers(histogram, capacity, length_buckets(histogram, buckets), close)
    spread = spread or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = ranked_by_size(items, key, spread)
    schema = items.select(key, "part", "start", "size").schema.add("container_id", T.LongType()).add("bucket", T.IntegerType())
    return ranked.select(key, "part", "start", "size", "rank").mapInArrow(_place(runs), schema)
