"""Heavy keys, histories and delivery changes against brute force, and their edge cases."""

import datetime as dt
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weir.functions.canonical import canonical_value, json_scalar
from weir.operators.buckets import bucket_members
from weir.operators.history import Satellites, change_rates
from weir.operators.skew import distinct_items_by_key
from weir.operators.snapshots import snapshot_changes

DAY = dt.datetime(2024, 1, 1)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("partitions", [1, 7])
def test_heavy_keys_count_like_brute_force(spark, partitions):
    rng = random.Random(3)
    rows = [("a", "hot", f"i{rng.randrange(900)}") for _ in range(3000)]
    rows += [(rng.choice("ab"), f"k{rng.randrange(200)}", f"i{rng.randrange(30)}") for _ in range(3000)]
    rows += [("a", None, "x"), ("b", "k", None), (None, "k", "x")]
    want = defaultdict(set)
    for t, k, i in rows:
        if None not in (t, k, i):
            want[t, k].add(i)
    df = spark.createDataFrame(rows, "t string, k string, i string").withColumn("n", F.lit(1)).withColumn("edge", F.lit("clash")).repartition(5)
    got = {(r.t, r.k): r.n for r in distinct_items_by_key(df, ["t", "k"], "i", partitions=partitions).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    few = {(r.t, r.k) for r in distinct_items_by_key(df, ["t", "k"], "i", more_than=20, partitions=partitions).collect()}
    assert few == {k for k, v in want.items() if len(v) > 20}


def test_heavy_keys_edges(spark):
    empty = spark.createDataFrame([], "t string, k string, i string")
    assert distinct_items_by_key(empty, ["t", "k"], "i").count() == 0
    same = spark.createDataFrame([("t", "k", "i")] * 500, "t string, k string, i string")
    assert rows_of(distinct_items_by_key(same, ["t", "k"], "i", partitions=6)) == [("t", "k", 1)]
    long = spark.createDataFrame([("t", "x" * 100_000, "i")], "t string, k string, i string")
    assert distinct_items_by_key(long, ["t", "k"], "i").collect()[0].n == 1


def test_a_heavy_key_spans_partitions(spark):
    rows = spark.range(20_000).select(F.lit("t").alias("t"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.col("id").cast("string").alias("i"))
    ranged = rows.repartitionByRange(8, "t", "k", "i")
    sizes = ranged.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 2
    assert distinct_items_by_key(rows, ["t", "k"], "i", more_than=1, partitions=8).collect()[0].n == 6667


def test_bucket_members(spark):
    rows = [
        (" 1 ", "acme", "CA", "ann lee", ["5", "5", None, ""], "h", DAY),
        ("1", "acme", "CA", "ann lee", ["5"], "h", DAY),
        ("2", "acme", "CA", "", None, "h", DAY),
        ("3", None, "CA", "ann lee", ["5"], "h", DAY),
        (None, "acme", "CA", "ann lee", ["5"], "h", DAY),
        ("", "acme", "CA", "ann lee", ["5"], "h", DAY),
    ]
    df = spark.createDataFrame(rows, "npi string, name_key string, state_key string, official_key string, phones array<string>, keys_hash string, updated_at timestamp")
    assert set(rows_of(bucket_members(df))) == {("no", "acme|ann lee", "1"), ("np", "acme|5", "1"), ("op", "ann lee|5", "1"), ("op", "ann lee|5", "3")}


CHANGES = "run string, npi string, at timestamp, a double, b double"


def changes(spark, rows, runs):
    return rows_of(
        snapshot_changes(spark.createDataFrame(rows, CHANGES), spark.createDataFrame(runs, "id string, v string"), key="npi", measures=["a", "b"], run="run", run_id="id", version="v", latest="at")
    )


def test_delivery_changes(spark):
    later = DAY + dt.timedelta(hours=1)
    rows = [
        ("r1", "1", DAY, 1.0, None), ("r1", " 2", DAY, 1.0, 2.0), ("r1", "3", DAY, 5.0, 5.0), ("r1", "4", DAY, 0.0, 1.0),
        ("r2", "1", DAY, 1.0000001, None), ("r2", "2 ", DAY, 1.0, None), ("r2", "4", DAY, -0.001, 1.0), ("r2", "5", DAY, 1.0, 1.0), ("r2", "5", DAY, 1.0, 1.0),
        ("r3", "1", DAY, 9.0, 9.0), ("r3", "1", later, 1.0, None), ("r3", "2", DAY, 1.0, None), ("r3", "4", DAY, 0.0, 1.0), ("r3", "5", DAY, 1.0, 1.0),
        ("r3", None, DAY, 1.0, 1.0), ("r3", "  ", DAY, 1.0, 1.0), ("other", "9", DAY, 1.0, 1.0),
    ]
    runs = [("r2", "2024-02-01"), ("r1", "2024-01-01"), ("r3", "2024-03-01")]
    assert changes(spark, rows, runs) == [("r2", "2", "changed"), ("r2", "3", "removed"), ("r2", "5", "added")]
    # a delivery without rows removes everything, and the next adds it
    assert changes(spark, [r for r in rows if r[0] != "r2"], runs)[:4] == [("r2", "1", "removed"), ("r2", "2", "removed"), ("r2", "3", "removed"), ("r2", "4", "removed")]
    assert changes(spark, [], runs) == [] == changes(spark, rows, [])


def test_delivery_changes_like_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"r{rng.randrange(4)}", str(rng.randrange(40)), DAY + dt.timedelta(seconds=i), rng.choice([None, 1.0, 2.0]), rng.choice([0.0, 1.004, 1.0])) for i in range(400)]
    latest = {}
    for run, npi, _, a, b in rows:
        latest[run, npi] = (a, round(b, 2))
    want = []
    for i in range(1, 4):
        for npi in {k[1] for k in latest}:
            old, new = latest.get((f"r{i - 1}", npi)), latest.get((f"r{i}", npi))
            if old != new:
                want.append((f"r{i}", npi, "added" if old is None else "removed" if new is None else "changed"))
    assert changes(spark, rows, [(f"r{i}", f"2024-0{i + 1}") for i in range(4)]) == sorted(want)


HISTORY = "npi string, f string, on string, at timestamp, id string, v string"


def versions(spark, rows, folder, batches=1):
    df = spark.createDataFrame(rows, HISTORY)
    store = Satellites(spark, str(folder), change_rates(df, key="npi", attribute="f"), key="npi", attribute="f", effective="on", order=["at", "id"])
    for i in range(batches):
        batch = [r for j, r in enumerate(rows) if j % batches == i]
        clash = {name: F.lit("clash") for name in ("k", "a", "h", "w", "told", "satellite")}
        store.load(spark.createDataFrame(batch, HISTORY).withColumns(clash), F.col("v"))
    return sorted(((r.npi, r.f, r.value, r.valid_from, r.valid_to) for r in store.view().collect()), key=str)


def test_history_versions(spark, tmp_path):
    rows = [
        ("1", "x", "2024-01-01", DAY, "a", "A"), ("1", "x", "2024-01-02", DAY, "b", "A"), ("1", "x", "2024-01-03", DAY, "c", None), ("1", "x", "2024-01-05", DAY, "d", "A"),
        ("1", "x", "2024-01-05", DAY, "c", "Z"), ("1", "x", "2024-01-05", DAY, "d", "A"), ("1", "y", "2024-01-01", DAY, "e", None),
        (None, "x", "2024-01-01", DAY, "f", "A"), ("1", None, "2024-01-01", DAY, "g", "A"), ("1", "x", None, DAY, "h", "A"),
    ]
    assert versions(spark, rows, tmp_path / "a") == [
        ("1", "x", "A", "2024-01-01", "2024-01-03"), ("1", "x", "A", "2024-01-05", "9999-12-31"), ("1", "x", None, "2024-01-03", "2024-01-05"), ("1", "y", None, "2024-01-01", "9999-12-31"),
    ]
    assert versions(spark, [], tmp_path / "b") == []


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_history_like_brute_force(spark, tmp_path, batches):
    rng = random.Random(8)
    rows = [(str(rng.randrange(5)), rng.choice("xy"), f"2024-01-{rng.randrange(1, 20):02d}", DAY + dt.timedelta(seconds=rng.randrange(50)), f"{i:04d}", rng.choice(["A", "B", None])) for i in range(600)]
    best = {}
    for n, f, on, at, i, v in sorted(rows, key=lambda r: (r[3], r[4])):
        best[n, f, on] = v
    by = defaultdict(list)
    for (n, f, on), v in sorted(best.items()):
        if not by[n, f] or by[n, f][-1][1] != v:
            by[n, f].append((on, v))
    want = [(n, f, v, on, vs[i + 1][0] if i + 1 < len(vs) else "9999-12-31") for (n, f), vs in by.items() for i, (on, v) in enumerate(vs)]
    assert versions(spark, rows, tmp_path / "s", batches) == sorted(want, key=str)


def test_satellites_split_by_change_rate(spark, tmp_path):
    rows = [("1", "fast", f"2024-01-{d:02d}", DAY, str(d), str(d)) for d in range(1, 9)] + [("1", "slow", "2024-01-01", DAY, "s", "A"), ("2", "slow", "2024-01-01", DAY, "t", "B")]
    df = spark.createDataFrame(rows, HISTORY)
    rates = change_rates(df, key="npi", attribute="f")
    assert {r.f: r.satellite for r in rates.collect()} == {"fast": "fast", "slow": "slow"}
    store = Satellites(spark, str(tmp_path / "s"), rates, key="npi", attribute="f", effective="on", order=["at", "id"])
    store.load(df, F.col("v"))
    store.load(df, F.col("v"))  # again: nothing is appended
    again = [("1", "slow", "2024-02-01", DAY, "u", "A"), ("1", "new", "2024-02-01", DAY, "u", "A")]
    store.load(spark.createDataFrame(again, HISTORY), F.col("v"))
    stored = lambda n: Counter(r.satellite for r in spark.read.parquet(str(tmp_path / f"s/load={n}")).collect())
    assert stored(0) == {"fast": 8, "slow": 2} and stored(2) == {"seen": 1, "slow": 1}
    assert not [f for _, _, files in os.walk(tmp_path / "s/load=1") for f in files if f.endswith(".parquet")]
    # what only repeated a value is a version once another comes in between
    store.load(spark.createDataFrame([("1", "slow", "2024-01-15", DAY, "w", "B")], HISTORY), F.col("v"))
    assert [(r.value, r.valid_from) for r in store.view().filter("npi = '1' and f = 'slow'").orderBy("valid_from").collect()] == [("A", "2024-01-01"), ("B", "2024-01-15"), ("A", "2024-02-01")]


@pytest.mark.parametrize(
    ("field", "raw", "want"),
    [
        ("phone", '"1-492-800-7742"', "4928007742"), ("phone", "3914171342.0", "3914171342"), ("phone", '"12"', "12"), ("phone", '"x"', None),
        ("address_postal_code", "7273.0", "07273"), ("address_postal_code", '"75062332"', "075062332"), ("address_postal_code", '""', None),
        ("lastupdated", '"6/7/2020"', "2020-06-07"), ("lastupdated", '"2025-08-13T00:00:00"', "2025-08-13"), ("lastupdated", "soon", "SOON"),
        ("status", '"A"', "active"), ("status", "D", "deactivated"), ("status", '"Active"', "active"), ("isorganization", '"Yes"', "true"), ("isorganization", "0", "false"),
        ("taxonomy_codes", '"{b,\\"a\\"}"', "A,B"), ("name", '" two  words "', "TWO WORDS"), ("name", "{}", None), ("name", "null", None), ("name", None, None), ("name", '"a\\"b"', 'A"B'), ("name", '"broken', '"BROKEN'),
    ],
)
def test_canonical_values(spark, field, raw, want):
    df = spark.createDataFrame([(field, raw)], "f string, v string")
    assert df.select(canonical_value(F.col("f"), json_scalar(F.col("v")))).collect()[0][0] == want


def test_change_rates_count_keys_exactly(spark):
    sizes = range(200, 2200, 200)
    df = spark.createDataFrame([(f"f{n}", f"k{i % n}") for n in sizes for i in range(n * 3 // 2)] + [("f200", None)] * 9, "f string, npi string")
    got = {r.f: (r["keys"], r.satellite) for r in change_rates(df.filter("npi is not null"), key="npi", attribute="f").collect()}
    assert got == {f"f{n}": (n, "fast") for n in sizes}  # each exactly on the limit
    assert {r.f: r["keys"] for r in change_rates(df, key="npi", attribute="f").collect()} == {f"f{n}": n for n in sizes}
