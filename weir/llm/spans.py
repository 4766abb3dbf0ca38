"""Long exact spans that records share, found through a log-structured index of window fingerprints.

A window is `span` characters. Of the hashes of its k-grams (k = span / 2) the least is its anchor, which only depends on
the window's own text, so that equal windows have equal anchors, wherever they stand. Consecutive windows with the same
anchor form a run, about one for every 50 characters of a text. The index is a log of sorted, immutable tables of runs,
each written once for a batch of records, bucketed by anchor hash and by a cell of records, so that an anchor
that stands in a third of all records is spread over buckets.

1. A new batch is written as a table of its own, and merge-joined with each table of the log, none of which is shuffled
   again: an anchor of the batch that stands in the log too, or in several records of the batch, is a candidate.
2. Whether the candidates' windows are equal is verified on the texts: a whole run at once where it is the same in several
   records, and window by window at the borders of shared passages. Windows are compared by 128 bits of hash. What a batch
   shares, with itself or with history, is appended to what was found before; nothing is compared a second time.
3. The log is compacted as its tables become many, bucket by bucket, without a shuffle.

No pair of records is ever formed, so that a passage in a third of all records costs each record its own length only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.bits import may_have_partner
from weir.scratch import Scratch

#: Cells of records that an anchor's runs are spread over: one for so many buckets of a table, and at least the first number.
CELLS, BUCKETS_A_CELL = 8, 64
#: Characters hashed at once; longer texts and batches are taken in slices, which changes no result.
SLICE = 1 << 20
_POS = np.uint64((1 << 21) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that they have inverses


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.array([1] + [b] * (size - 1), np.uint64)) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASES]


class Hashes:
    """Hash of any substring of a slice in constant time, from prefix sums of weighted characters."""

    def __init__(self, codes: np.ndarray, which: int):
        self.up, down = _POWERS[which].get(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(which + 1)) * down[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.up[start])


def codes_of(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slices(lengths: list[int], span: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (record, from, to) of about SLICE characters; the parts of a long record overlap by a window less one."""
    group, size = [], 0
    for i, n in enumerate(lengths):
        at = 0
        while n - at >= span:
            to = min(n, at + SLICE)
            if size + to - at > SLICE and group:
                yield group
                group, size = [], 0
            group.append((i, at, to))
            size += to - at
            if to == n:
                break
            at = to - span + 1
    if group:
        yield group


def runs_of(texts: list[str], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(record, anchor hash, first window, last window, anchor position) of every run of the texts, a slice at a time."""
    k, w = span // 2, span - span // 2 + 1
    for group in _slices([len(t) for t in texts], span):
        codes = codes_of("".join(texts[i][a:b] for i, a, b in group))
        sizes = np.array([b - a for _, a, b in group])
        starts = np.cumsum(sizes) - sizes
        n = len(codes)
        position = np.arange(n - k + 1)
        anchors = Hashes(codes, 0).of(position, position + k)
        # the least hash of the w k-grams from each position on; its place sits in the low bits, the leftmost wins
        least = (anchors & ~_POS) | position.astype(np.uint64)
        width = 1
        while 2 * width <= w:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < w:
            least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
        own = np.repeat(np.arange(len(group)), sizes)[: n - span + 1]
        inside = position[: n - span + 1] + span <= (starts + sizes)[own]
        at = np.flatnonzero(inside)
        place = (least[: n - span + 1][at] & _POS).astype(np.int64)
        own = own[at]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        of = own[first]
        shift = np.array([a for _, a, _ in group])[of] - starts[of]
        yield np.array([i for i, _, _ in group])[of], anchors[place[first]].view(np.int64), at[first] + shift, at[last] + shift, place[first] + shift


def _fingerprint(span: int):
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for record, anchor, first, last, at in runs_of(texts, span):
                # a run is 40 bits of start, and two lengths of at most half a span
                packed = (first << 24) | ((last - first) << 12) | (at - first)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), batch.column(0).take(pa.array(record)), pa.array(packed)], names=["h", "doc", "run"])

    return fingerprint


class SpanIndex:
    """A log of tables (h, cell, doc, run), each bucketed by anchor hash and cell and sorted by both, written once and never changed."""

    def __init__(self, scratch: Scratch, *, span: int = 200, buckets: int | None = None, fan_out: int = 2):
        if not 2 <= span < 8192:
            raise ValueError("span must be from 2 to 8191 characters")
        self.spark, self.scratch, self.span, self.fan_out = scratch.spark, scratch, span, fan_out
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.cells = max(CELLS, self.buckets // BUCKETS_A_CELL)
        self.tables: list[tuple[int, str]] = []  # level and name; later batches follow earlier ones
        self.found: list[DataFrame] = []  # (doc, start, stop), written tables
        self.key = "bigint"

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"weir_runs_{uuid.uuid4().hex[:16]}"
        writer = rows.write.option("path", f"{self.scratch.path}/{name}")
        writer.bucketBy(self.buckets, "h", "cell").sortBy("h", "cell").format("parquet").saveAsTable(name)
        self.tables.append((level, name))
        return name

    def append(self, batch: DataFrame, doc: str, text: str, records: DataFrame | None = None) -> None:
        """Adds a batch of records: what it shares with itself and with the log, then its runs, as a new table.

        records has the texts of all that was indexed so far and of the batch; those without a candidate, and others, are
        passed over. Without it the batch is all there is. Null texts, and texts shorter than a span, share nothing. Records
        are told apart by `doc`: a repeated row, also in another batch, isn't another record.
        """
        rows = self._texts(batch, doc, text)
        schema = T.StructType([T.StructField("h", T.LongType()), rows.schema["doc"], T.StructField("run", T.LongType())])
        celled = rows.mapInArrow(_fingerprint(self.span), schema).withColumn("cell", F.pmod(F.xxhash64("doc"), F.lit(self.cells)).cast("int"))
        log = [name for _, name in self.tables]
        name = self._write(celled.repartition(self.buckets, "h", "cell").distinct(), 0)
        hits, n = self._candidates(name, log)
        self.key = rows.schema["doc"].dataType.simpleString()
        if n:
            texts = self._texts(batch if records is None else records, doc, text)
            self.found.append(_verified(reduce(DataFrame.unionByName, hits), n, texts, self.span, self.scratch))
        self.scratch.drop(*hits)
        self.compact()

    def _texts(self, records: DataFrame, doc: str, text: str) -> DataFrame:
        return records.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= self.span))

    def _celled(self, anchors: DataFrame) -> DataFrame:
        return anchors.select("h", F.explode(F.sequence(F.lit(0), F.lit(self.cells - 1))).alias("cell"))

    def _candidates(self, name: str, log: list[str]) -> tuple[list[DataFrame], int]:
        """Tables (h, doc, run) of the new and the log's runs whose anchor the new table shares, and how many they are."""
        new = self.spark.table(name)
        anchors = new.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        shared, hits, n = anchors.filter("lo < hi").select("h"), [], 0
        if log:
            keys = self._celled(anchors)
            old = reduce(DataFrame.unionByName, [self.spark.table(t).join(keys, ["h", "cell"], "left_semi").select("h", "doc", "run") for t in log])
            old, n = self.scratch.keep_counted(old)
            shared, hits = shared.unionByName(old.select("h")).distinct(), [old]
        own, m = self.scratch.keep_counted(new.join(self._celled(shared), ["h", "cell"], "left_semi").select("h", "doc", "run"))
        return [*hits, own], n + m

    def shared(self) -> DataFrame:
        """(doc, shared_chars) of the records with a span that also stands in another one, in code points as stored.

        Exact: every window that stands in two records was found when the later of their batches came, as both have its
        anchor in the index. Without records there are no rows.
        """
        if not self.found:
            return self.spark.createDataFrame([], f"doc {self.key}, shared_chars bigint")
        return covered(reduce(DataFrame.unionByName, self.found))

    def compact(self) -> None:
        """Merges fan_out tables of a level into one of the next, so that a log of n batches has about log n tables.

        Two tables are merged by an outer join on all columns: both have the same buckets, which is all that the merge needs,
        so that nothing is shuffled. With a larger fan_out the third table on is.
        """
        whole_keys, level = "spark.sql.requireAllClusterKeysForCoPartition", 0
        before = self.spark.conf.get(whole_keys)
        while level <= max((at for at, _ in self.tables), default=-1):
            own = [name for at, name in self.tables if at == level]
            if len(own) >= self.fan_out:
                self.spark.conf.set(whole_keys, "false")
                try:
                    self._write(reduce(lambda a, b: a.hint("merge").join(b, ["h", "cell", "doc", "run"], "full"), map(self.spark.table, own)), level + 1)
                finally:
                    self.spark.conf.set(whole_keys, before)
                self.tables = [t for t in self.tables if t[1] not in own]
                self.drop(own)
            level += 1

    def drop(self, names: list[str] | None = None) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in names or [name for _, name in self.tables]:
            self.spark.sql(f"drop table if exists {name}")
            at = path(f"{self.scratch.path}/{name}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _hash128(texts_codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, pa.Array]:
    return tuple(pa.array(Hashes(texts_codes, which).of(start, end).view(np.int64)) for which in (0, 1))


def _unpack(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = run >> 24
    return first, first + ((run >> 12) & 0xFFF), first + (run & 0xFFF)


def _run_texts(span: int):
    """For each candidate run of a record: two hashes of the run's text and of where its anchor and windows lie, and the text."""

    def run_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                runs = batch.column(2)[row].values
                anchor, run = (runs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                first, last, at = _unpack(run)
                parts = [text[a : b + span] for a, b in zip(first.tolist(), last.tolist())]
                codes = codes_of("".join(parts))
                size = last - first + span
                end = np.cumsum(size)
                shape = ((at - first) * 4096 + (last - first)).astype(np.uint64)
                r1, r2 = (_mix(Hashes(codes, which).of(end - size, end) ^ _mix(shape + np.uint64(7))).view(np.int64) for which in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(r1), pa.array(r2), pa.array([batch.column(0)[row].as_py()] * len(run), batch.schema.field(0).type), pa.array(first), pa.array(last), pa.array(parts)],
                    names=["h", "r1", "r2", "doc", "first", "last", "part"],
                )

    return run_texts


def _windows(span: int):
    """Every window of the runs' texts: two hashes, its record and where it starts."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in range(0, batch.num_rows, 2000):
                part = batch.slice(piece, 2000)
                texts = part.column(2).to_pylist()
                size = np.array([len(t) for t in texts])
                codes = codes_of("".join(texts))
                count = size - span + 1
                row = np.repeat(np.arange(len(texts)), count)
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = (np.cumsum(size) - size)[row] + inner
                w1, w2 = _hash128(codes, start, start + span)
                first = part.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([w1, w2, part.column(0).take(pa.array(row)), pa.array(first[row] + inner)], names=["w1", "w2", "doc", "start"])

    return windows


def covered(intervals: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, shared_chars): characters that lie in at least one of a record's intervals [start, stop).

    A record's intervals are at most as many as its windows, so that grouping them stays in proportion to its own text.
    """
    merge = lambda acc, x: F.struct(
        F.greatest(acc["stop"], x["stop"]).alias("stop"),
        (acc["chars"] + F.greatest(x["stop"] - F.greatest(acc["stop"], x["start"]), F.lit(0).cast("bigint"))).alias("chars"),
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("stop"), F.lit(0).cast("bigint").alias("chars"))
    lists = intervals.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("all"))
    return lists.select(doc, F.aggregate("all", zero, merge, lambda a: a["chars"]).alias("shared_chars"))


def _verified(hits: DataFrame, n: int, texts: DataFrame, span: int, scratch: Scratch) -> DataFrame:
    """(doc, start, stop): spans of the candidate runs that stand in at least two records, as a written table."""
    lists = hits.groupBy("doc").agg(F.collect_set(F.struct("h", "run")).alias("runs"))
    joined = may_have_partner(texts, "doc", hits, "doc", n).dropDuplicates(["doc"]).join(lists, "doc").select("doc", "text", "runs")
    key = hits.schema["doc"].dataType
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in ("h", "r1", "r2")), T.StructField("doc", key), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("part", T.StringType())])
    runs = scratch.keep(joined.mapInArrow(_run_texts(span), schema))
    kinds = scratch.keep(runs.groupBy("h", "r1", "r2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")))
    same = kinds.filter("lo < hi").select("h", "r1", "r2")
    whole = runs.join(same, ["h", "r1", "r2"], "left_semi").select("doc", F.col("first").alias("start"), (F.col("last") + span).alias("stop"))
    # anchors with a run that no other record has: its windows may still stand in the anchor's other runs
    mixed = kinds.groupBy("h").agg(F.count("*").alias("n"), F.count_if(F.col("lo") == F.col("hi")).alias("lone")).filter("n > 1 and lone > 0").select("h")
    ends = kinds.join(mixed, "h", "left_semi").select("h", "r1", "r2", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("doc"))
    borders = runs.join(ends, ["h", "r1", "r2", "doc"], "left_semi").select("doc", "first", "part")
    schema = T.StructType([T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), T.StructField("doc", key), T.StructField("start", T.LongType())])
    windows = scratch.keep(borders.mapInArrow(_windows(span), schema))
    twice = windows.groupBy("w1", "w2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("w1", "w2")
    single = windows.join(twice, ["w1", "w2"], "left_semi").select("doc", "start", (F.col("start") + span).alias("stop"))
    found = scratch.keep(whole.unionByName(single))
    scratch.drop(runs, kinds, windows)
    return found
