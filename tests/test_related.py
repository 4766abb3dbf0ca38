"""Shared keys, pages of groups, text similarity and merged branches."""

import random

import pytest
from pyspark.sql import functions as F

from weir.operators import related as N
from weir.plans import search


def test_related_respects_caps(spark):
    rows = [("1", "a", "x"), ("2", "a", "x"), ("3", "b", "x"), ("4", None, "y"), ("5", "c", None)] + [(f"m{i}", "big", None) for i in range(9)]
    df = spark.createDataFrame(rows, "id string, k string, o string")
    got = {(r.id, r.other): r.why for r in N.related(df, "id", {"k": (["k"], 6), "o": (["o"], 3)}, top=1).collect()}
    assert got == {("1", "2"): "k+o", ("2", "1"): "k+o", ("3", "1"): "o"}


@pytest.mark.parametrize(("a", "b", "want"), [("b a", "A  b", 100), ("abc", "abd", 67), (None, "x", None), ("", "", 100), ("x" * 3000, "y", 0)])
def test_token_sort_ratio(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(N.token_sort_ratio(F.col("a"), F.col("b"))).collect()[0][0] == want


def test_pages_hold_whole_groups(spark):
    rows = [("s", g, i) for g, n in (("a", 2), ("b", 3), ("c", 1), ("d", 7), ("e", 1)) for i in range(n)] + [("t", "a", 0)]
    got = {(r.s, r.g): r.page for r in N.group_pages(spark.createDataFrame(rows, "s string, g string, i int"), "s", "g", ["g"], 4).collect()}
    assert got == {("s", "a"): 0, ("s", "b"): 0, ("s", "c"): 1, ("s", "d"): 1, ("s", "e"): 2, ("t", "a"): 0}


def test_branches_and_modes(spark):
    rows = [("1", "o", "p", "n"), ("2", "o", "p", "m"), ("3", "o", None, "m"), ("4", None, None, None)]
    df = spark.createDataFrame(rows, "id string, o string, p string, n string")
    assert {r.id: r.branch for r in N.branches_merged(df, [["o", "p"], ["n", "o"]], "id").collect()} == {"1": "1", "2": "1", "3": "1", "4": "4"}
    assert [tuple(r) for r in N.most_common(df.withColumn("g", F.lit(1)), ["g"], "n", "times").collect()] == [(1, "m", 2)]
    assert N.with_key_size(df, ["o"], "n_o").filter("n_o = 3").count() == 3


def branches_by_brute_force(rows, rules):
    found = {r["id"]: r["id"] for r in rows}
    held = [(r["id"], (i, *[r[k] for k in keys])) for r in rows for i, keys in enumerate(rules) if all(r[k] is not None for k in keys)]
    while True:
        least = {}
        for id, key in held:
            least[key] = min(least.get(key, found[id]), found[id])
        new = dict(found)
        for id, key in held:
            new[id] = min(new[id], least[key])
        if new == found:
            return found
        found = new


def test_branches_go_on_through_linked_records(spark):
    rules = [["o", "p"], ["n", "o"]]
    merged = lambda rows: {r.id: r.branch for r in N.branches_merged(spark.createDataFrame(rows, "id string, o string, p string, n string"), rules, "id").collect()}
    assert merged([("1", "o", None, "n"), ("3", "o", "p", "n"), ("5", "o", "p", None)]) == {"1": "1", "3": "1", "5": "1"}
    assert merged([("1", "o", None, "n"), ("2", "o", "p", None), ("3", "o", "p", "n")]) == {"1": "1", "2": "1", "3": "1"}  # 3 joins what stood apart
    assert merged([("1", None, "p", "n"), ("2", None, "p", "n"), ("2", "o", None, None)]) == {"1": "1", "2": "2"}
    rng = random.Random(2)
    rows = [(f"r{rng.randrange(400):03d}", "o", f"{rng.randrange(260)}", f"{rng.randrange(260)}") for _ in range(200)] + [(f"h{i:03d}", "big", "p", f"n{i}") for i in range(200)]
    order = rng.sample(range(150), 150)
    rows += [(f"s{a:03d}", "c", f"{i // 2}", f"{(i + 1) // 2}") for i, a in enumerate(order)] + [(f"t{i:03d}", "d", f"{i // 2}", f"{(i + 1) // 2}") for i in range(150)]
    assert merged(rows) == branches_by_brute_force([dict(zip("iopn", r)) | {"id": r[0]} for r in rows], rules)


def test_branches_by_every_phone(spark, tmp_path):
    rows = [
        ("1", "a", "o", ["2", "7"]), ("2", "b", "o", ["3", "7"]), ("3", "c", "o", ["", "4"]), ("4", "d", "o", ["", None, "5"]), ("5", "e", "o", [" ", "4", "4"]),
        ("6", "f", "o", []), ("7", "g", "o", None), ("8", "h", "", ["7"]),
    ]
    keys = spark.createDataFrame(rows, "npi string, name_key string, official_key string, phones array<string>")
    keys.withColumns({"state_key": F.lit("CA"), "updated_at": F.timestamp_seconds(F.lit(0))}).write.parquet(f"{tmp_path}/npi_identity_keys.parquet")
    found = {r.npi: r.branch for r in search.branches(spark, str(tmp_path)).collect()}
    assert found == {"1": "1", "2": "1", "3": "3", "4": "4", "5": "3", "6": "6", "7": "7", "8": "8"}
