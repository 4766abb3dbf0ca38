"""Results for each key where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _differs(column: pa.ChunkedArray, before: object) -> np.ndarray:
    """For each value whether it differs from the one before it; `before` precedes the first. Nulls are filtered beforehand."""
    out = np.empty(len(column), bool)
    out[0] = column[0].as_py() != before
    out[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return out


def _run_states(n_keys: int, least: int):
    """Reads a range partition sorted by keys and item, and yields a state for each of its keys.

    A key inside the partition is complete and leaves only with more than `least` items. The first and the last key may
    go on in a neighbour; they always leave, marked as an edge, to be stitched. Memory is one batch, whatever the skew.
    """

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: tuple | None = None  # the key whose rows may go on
        open_item, open_count, first = None, 0, True

        def emit(keys: list[pa.Array], counts: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*keys, pa.array(counts, pa.int64()), pa.array(edge)], names=[*(f"k{i}" for i in range(n_keys)), "n", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [pa.chunked_array([batch.column(i)]) for i in range(n_keys + 1)]
            new_key = np.zeros(batch.num_rows, bool)
            for i in range(n_keys):
                new_key |= _differs(cols[i], open_key[i] if open_key else None)
            new_item = new_key | _differs(cols[n_keys], open_item)
            starts = np.flatnonzero(new_key)
            if not len(starts) or starts[0] > 0:
                open_count += int(new_item[: starts[0] if len(starts) else None].sum())
            if len(starts):
                if open_key is not None:
                    if first or open_count > least:
                        yield emit([pa.array([k], pa.string()) for k in open_key], np.array([open_count]), np.array([first]))
                    first = False
                counts = np.add.reduceat(new_item.astype(np.int64), starts)
                done, done_counts = starts[:-1], counts[:-1]
                edge = np.zeros(len(done), bool)
                if len(done) and first:
                    edge[0], first = True, False
                keep = edge | (done_counts > least)
                if keep.any():
                    at = pa.array(done[keep])
                    yield emit([c.take(at).combine_chunks().cast(pa.string()) for c in cols[:n_keys]], done_counts[keep], edge[keep])
                open_key, open_count = tuple(c[int(starts[-1])].as_py() for c in cols[:n_keys]), int(counts[-1])
            open_item = cols[n_keys][batch.num_rows - 1].as_py()
        if open_key is not None:
            yield emit([pa.array([k], pa.string()) for k in open_key], np.array([open_count]), np.array([True]))

    return states


def distinct_items_by_key(df: DataFrame, keys: Sequence[str], item: str, *, more_than: int = 0, partitions: int | None = None) -> DataFrame:
    """(keys, n): the number of distinct items of each key that has more than `more_than`.

    Rows are range-partitioned on (keys, item), whose quantiles Spark samples: a heavy key spans as many partitions as its
    share asks for, and equal items still meet in one. Each partition sorts its rows and counts distinct items in a single
    pass; only the keys at its two ends are partial. Those states, two for each partition, are then added up.

    Keys and items are strings; rows with a null in any of them are left out. Repeated rows count once; remove a row that
    is repeated very often (a third of all) before, as equal rows can't be split. Further columns are ignored.
    An empty table gives no rows.
    """
    cols = [*keys, item]
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).dropna()
    ranged = rows.repartitionByRange(partitions, *cols) if partitions else rows.repartitionByRange(*cols)
    schema = ", ".join([*(f"k{i} string" for i in range(len(keys))), "n bigint", "edge boolean"])
    states = ranged.sortWithinPartitions(*cols).mapInArrow(_run_states(len(keys), more_than), schema)
    total = states.groupBy(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]).agg(F.sum("n").alias("n"))
    return total.filter(F.col("n") > more_than)
