"""Contacts, groups and candidate matches by hand and against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from weir.functions import labels as L
from weir.operators import activity as V
from weir.operators import apply as A
from weir.operators import callbook as B
from weir.operators import contacts as K
from weir.operators import criteria as C
from weir.operators import groups as U
from weir.operators import identity as I
from weir.operators import related as N

DAY = dt.datetime(2024, 1, 1)
at = lambda h: DAY + dt.timedelta(hours=h)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_last_touch(spark):
    schema = "key string, at timestamp_ntz, note string"
    a = spark.createDataFrame([("1", at(1), "x"), ("1", at(3), "x"), ("2", None, "x"), (None, at(9), "x")], schema)
    b = spark.createDataFrame([("1", at(3), "y"), ("3", at(2), "y")], schema)
    assert rows_of(K.last_touch({"b": b, "a": a})) == [("1", at(3), "a"), ("3", at(2), "b")]
    assert K.last_touch({"a": a.limit(0)}).count() == 0


def test_streaks_and_misses(spark):
    days = [("u", at(24 * d)) for d in (0, 1, 2, 4, 5)] + [("v", at(0)), ("w", at(24 * 4))]
    df = spark.createDataFrame(days, "who string, at timestamp_ntz")
    assert rows_of(K.current_streak(df, "who", "at", F.lit("2024-01-06").cast("date"))) == [("u", 2), ("w", 1)]
    calls = [("u", 1, at(1), "hit"), ("u", 2, at(2), "miss"), ("u", 3, at(2), "miss"), ("u", 4, at(3), "other"), ("v", 5, at(1), "miss"), ("v", 6, at(1), "hit"), ("w", 7, at(5), "miss"), (None, 8, at(1), "miss")]
    df = spark.createDataFrame(calls, "who string, id int, at timestamp_ntz, kind string")
    assert rows_of(K.misses_in_a_row(df, "who", "at", "id", F.col("kind") == "hit", F.col("kind") == "miss").filter("who is not null")) == [("u", 2, at(2)), ("w", 1, at(5))]


def test_quiet_and_first_response(spark):
    rows = [("a", at(0), "open", None), ("b", at(0), "done", None), ("c", at(0), None, at(99 * 24)), ("d", at(23 * 24), None, None), ("e", None, None, None)]
    df = spark.createDataFrame(rows, "id string, last timestamp_ntz, status string, next timestamp_ntz")
    got = K.quiet(df, F.col("last"), F.lit(at(24 * 24)), 2, done=F.col("status") == "done", ahead=[F.col("next")])
    assert rows_of(got.select("id", "quiet_days")) == [("a", 24)]
    starts = spark.createDataFrame([("a", at(0)), ("b", at(10)), ("c", at(0)), ("d", at(5))], "id string, s timestamp_ntz")
    contacts = spark.createDataFrame([("a", at(3)), ("a", at(1)), ("b", at(60)), ("d", at(1)), ("x", at(1))], "id string, t timestamp_ntz")
    assert rows_of(K.first_response(starts, contacts, "id", "s", "t")) == [(4, 2, 25.5, 1, 2)]


def test_labels_and_spellings(spark):
    df = spark.createDataFrame([("Acme Inc",), ("Acme Inc",), ("ACME",), (" ",), (None,)], "n string").withColumn("why", F.when(F.col("n") == "ACME", "late"))
    assert rows_of(K.counts_by_label(df, F.col("n"), "none", 2)) == [("Acme Inc", 2), ("none", 2)]
    key = F.nullif(F.trim(F.regexp_replace(F.lower("n"), "inc", "")), F.lit(""))
    assert rows_of(K.spelling_groups(df, key, "n", "why")) == [("acme", "Acme Inc", 3, "late:1")]
    places = spark.createDataFrame([("TX", "a"), ("TX", "b"), ("TX", "b"), ("CA", "a"), (None, "a"), ("TX", None)], "s string, l string")
    assert rows_of(K.patterns(places, "s", "l", least=3, top=1)) == [("TX", 4, "b", 2)]


def test_group_kinds(spark):
    rows = [("g", "acme", "ann lee")] * 2 + [("h", "acme", "ann lee"), ("h", "apex", "ann lee"), ("h", "apex", None), ("i", "a", "x"), ("i", "b", "y"), ("i", "c", None), ("j", None, None)]
    got = rows_of(K.group_kinds(spark.createDataFrame(rows, "g string, n string, o string"), "g", "n", "o"))
    assert got == [("g", 2, 1, "name", "acme", False), ("h", 3, 2, "official", "ann lee", False), ("i", 3, 3, "mixed", "a", True), ("j", 1, 0, "mixed", None, False)]


def test_pages_samples_and_best(spark):
    rows = [("b", i) for i in range(5)] + [("a", 10), ("c", 20), ("c", 21)]
    df = spark.createDataFrame(rows, "v string, n int")
    assert [tuple(r)[:2] for r in K.quota_page(df, "v", [F.col("n")], 5).collect()] == [("a", 10), ("b", 0), ("c", 20), ("b", 1), ("c", 21)]
    assert K.sample_rows(df, "n", 3, "7").collect() == K.sample_rows(df.repartition(5), "n", 3, "7").collect() != K.sample_rows(df, "n", 3, "8").collect()
    lists = K.capped_lists(df, {"even": (F.col("n") % 2 == 0, [F.desc("n")], 2), "b": (F.col("v") == "b", [F.asc("n")], 9)}, ["n"])
    assert [r.n for r in lists.filter("list = 'even'").orderBy("place").collect()] == [20, 10] and lists.filter("list = 'b'").count() == 5
    assert rows_of(K.best_of(df, "v", "n", [(F.col("n") % 2 == 1, 3), (F.col("n") > 3, 1)])) == [("a", 10, 1), ("b", 1, 3), ("c", 21, 4)]


def test_members_moves_and_conflicts(spark):
    keys = spark.createDataFrame([("1", "k", "TX"), ("2", "k", "CA"), ("3", "s", "TX"), ("4", "s", "")], "npi string, identity_key string, state string")
    members = spark.createDataFrame([("1", "g", "ann"), ("5", "g", "bo"), ("6", "h", "bo"), ("6", "h", None), (None, "g", "cy")], "npi string, group_id string, owner string")
    assert {(r.npi, r.cross_state) for r in U.new_members(keys, members).collect()} == {("2", True), ("3", False), ("4", False)}
    assert rows_of(U.owner_conflicts(members, "owner")) == [("g", 3, "ann,bo,cy")]
    wanted = spark.createDataFrame([("5", "h"), ("6", "g"), ("1", "g")], "npi string, group_id string")
    assert rows_of(U.moves(members, wanted, F.col("npi") == "6")) == [("5", "g", "h")]


def test_decisions_and_merges(spark):
    members = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b"), ("4", "c"), ("5", "d"), ("6", "e")], "npi string, group_id string")
    pairs = spark.createDataFrame([("1", "2", 2), ("3", "1", 3), ("4", "5", 3), ("1", "9", 2), ("2", "3", 2)], "left_npi string, right_npi string, tier int")
    decided = spark.createDataFrame([("5", "4", 0)], "left_npi string, right_npi string, tier int")
    found = U.undecided_groups(pairs, members, decided)
    assert rows_of(found) == [("a", "b", 2), ("a", "npi:9", 2)]
    owners = spark.createDataFrame([("a", "ann"), ("b", "bo"), ("b", "ann"), ("npi:9", None)], "group_id string, owner string")
    assert rows_of(U.merge_preview(found, owners)) == [(2, 1, 1)]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e")], "a string, b string")
    assert rows_of(U.merged_groups(members, links)) == [("1", "b"), ("2", "b"), ("3", "b"), ("4", "b"), ("5", "d"), ("6", "d")]
    assert rows_of(U.merged_groups(members, links.limit(0))) == rows_of(members)


def similar(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 100 if not a and not b else int(200 * row[-1] / (len(a) + len(b)) + 0.5)


def test_candidates_like_brute_force(spark):
    rng = random.Random(5)
    names = ["acme home care", "acme home cares", "apex supply", "home acme care", None, ""]
    record = lambda i: (f"{i:010d}", rng.choice(names), rng.choice(["TX", "CA", None]), rng.choice(["ann lee", "bo ray", "", None]), rng.choice(["2125550100", "2125550101", None]))
    left, right = [record(i) for i in range(30)], [record(100 + i) for i in range(40)]
    schema = "npi string, name string, state string, official string, phone string"
    want = {}
    for a in left:
        for b in right:
            same = [bool(x) and x == y for x, y in zip(a[1:], b[1:])]
            if not (same[0] or same[2] or same[3]):
                continue
            fuzzy = not same[0] and (same[2] or same[3]) and bool(a[1]) and bool(b[1]) and similar(a[1], b[1]) >= 88
            have = dict(zip(U.SIGNALS, [same[0] or fuzzy, *same[1:]]))
            for tier, keys, auto in U.RULES:
                if all(have[k] for k in keys.split("+")):
                    by_name = "name" in keys
                    want[a[0], b[0]] = (tier, keys, ("fuzzy" if fuzzy else "exact") if by_name else None, auto and not (fuzzy and by_name))
                    break
    found = U.candidate_matches(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    assert {(r.npi, r.other): (r.tier, r["keys"], r.name_match, r.automatic) for r in found.collect()} == want
    assert any(v[2] == "fuzzy" for v in want.values())
    none = spark.createDataFrame([], schema)
    assert U.candidate_matches(none, none).count() == 0


def test_preflight(spark):
    ids = ["1" * 10, "2" * 10, "3" * 10, "4" * 10, "5" * 10]
    candidates = spark.createDataFrame([(i,) for i in [*ids, ids[0], "12", None]], "npi string")
    matches = spark.createDataFrame([(ids[1], "x", 1, True), (ids[2], "y", 2, False), (ids[3], "z", 1, True)], "npi string, other string, tier int, automatic boolean")
    members = spark.createDataFrame([("x", "g"), ("z", "h"), (ids[4], "i")], "npi string, group_id string")
    owners = spark.createDataFrame([("g", "ann")], "group_id string, owner string")
    got = U.preflight(candidates, spark.createDataFrame([(ids[0],)], "npi string"), matches, members, owners)
    assert {(r.npi, r.decision, r.group_id) for r in got.collect()} == {
        (ids[0], "duplicate", None), (ids[1], "owned_conflict", "g"), (ids[2], "needs_review", None), (ids[3], "accept", "h"), (ids[4], "accept", "i"), ("12", "invalid", None), (None, "invalid", None),
    }


def test_verdicts_and_filling(spark):
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("3",)], "k string")
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "n string")
    assert rows_of(U.verdicts(ids, "k", [("a", one("1", None)), ("b", one("1", "2", "2"))], "c")) == [("1", "a"), ("2", "b"), ("3", "c")]
    ours = spark.createDataFrame([("1", "old", " ", None), ("2", "old", "5", "x")], "k string, name string, phone string, line string")
    told = spark.createDataFrame([("1", "new", "9"), ("1", "newer", "9"), ("2", "new", "9")], "k string, name string, phone string")
    assert rows_of(U.filled(ours, told, "k", theirs_first=["name"], ours_first=["phone"], lacking=F.col("line").isNull())) == [("1", "new", "9", None), ("2", "old", "5", "x")]


def test_call_book(spark):
    rows = [("212-555-0100", "2024-01-02 10:00", "95", " Ann  Lee ", "x"), ("212-555-0100", "1/2/2024 10:00 AM", "1:35", "Ann Lee", None), ("212", "2024-01-02", "1", None, None), ("2125550100", "soon", None, None, None), ("2125550100", "2030-01-01", None, None, None), (None, None, None, None, None), ("2125550101", "2024-01-02", "99999999", None, "no answer")]
    calls = B.read_calls(spark.createDataFrame(rows, "phone string, at string, length string, agent string, result string"), F.lit(at(48)))
    reasons = [r.reason for r in calls.collect()]
    assert reasons == [None, None, "no valid phone number", "no valid date", "date out of range", "no valid phone number", None]
    assert rows_of(B.new_calls(calls, calls.limit(0)).select("agent", "phone", "seconds", "result")) == [("", "2125550101", None, "no answer"), ("Ann Lee", "2125550100", 95, "x")]
    assert B.new_calls(calls, calls.filter("agent = 'Ann Lee'").limit(1)).count() == 1
    assert rows_of(B.call_totals(B.new_calls(calls, calls.limit(0)), "agent")) == [("", 1, 0, 0), ("Ann Lee", 1, 1, 2)]


def test_deliveries_applied(spark):
    schema = "npi string, claims double"
    live = spark.createDataFrame([("1", 10.0), ("2", 10.0), ("3", 10.0), ("4", None), ("5", 1.0)], schema)
    new = spark.createDataFrame([("1", 4.0), ("2", 10.0), ("3", None), ("4", 1.0), ("6", 1.0), ("7", 1.0)], schema)
    known = spark.createDataFrame([(str(i),) for i in (1, 2, 3, 4, 6)], "npi string")
    got = A.applied(A.compared(live, new, "npi", ["claims"]), "npi", ["claims"], known, known.filter("npi = '1'"), "claims")
    assert rows_of(got) == [("inserted", 1, 0), ("skipped", 1, 0), ("unchanged", 1, 0), ("updated", 3, 1)]
    both = A.compared(live, new, "npi", ["claims"])
    assert "4" not in {r.npi for r in A.field_history(both, "npi", ["claims"], first_fill=["claims"]).collect()} and "4" in {r.npi for r in A.field_history(both, "npi", ["claims"]).collect()}
    history = spark.createDataFrame([("1", "r", "b", None, "2"), ("1", "r", "a", None, "1"), ("1", "r", "a", None, "1"), ("2", "r", "a", None, "1"), ("1", None, "a", None, "1"), ("1", "s", "record_created", None, '{"a": 1}')], "npi string, run string, field_name string, old_value string, new_value string")
    assert rows_of(A.alerts(history, known.filter("npi = '1'"), "npi", "run", ["b"])) == [("1", "r", 2, "a,b", True), ("1", "s", 1, "record_created", False)]
    wide = history.filter("run = 's'").unionByName(history.limit(1).withColumn("new_value", F.lit('{"b": "x", "c": 1}')))
    assert {r.new_value for r in A.compacted(wide).collect()} == {'{"present":true}', "x"}


def test_years_builds_and_clusters(spark):
    rows = [("s", 1997, 5), ("t", 1996, 5), ("n", 1995, 1), ("n", 1997, 1), ("u", 1996, 10), ("u", 1997, 11), ("d", 1996, 10), ("d", 1997, 8), ("f", 1996, 10), ("f", 1997, 10), ("f", 1999, 1)]
    df = spark.createDataFrame([(k, dt.datetime(y, 1, 1), a) for k, y, a in rows], "k string, at timestamp_ntz, a int")
    assert {r.k: r.kind for r in V.year_kinds(df, "k", "at", F.col("a"), 1997).collect()} == {"s": "single", "t": "stopped", "n": "new", "u": "up", "d": "down", "f": "flat"}
    stored = spark.createDataFrame([("1", "2", "a", "b"), ("1", "3", "a", "b"), ("1", None, "a", "b")], "left_npi string, right_npi string, first_build_id string, last_build_id string")
    now = spark.createDataFrame([("1", "2"), ("2", "3"), ("2", "3")], "left_npi string, right_npi string")
    assert rows_of(I.build_lifecycle(stored, now, "c")) == [("1", "2", "a", "c", "kept"), ("1", "3", "a", "b", "dropped"), ("2", "3", "c", "c", "new")]
    people = [("1", "p", None), ("2", "p", "x"), ("3", "q", "x"), ("4", None, None), *[(f"b{i}", "big", None) for i in range(5)]]
    found = N.clusters(spark.createDataFrame(people, "id string, p string, o string"), "id", [(["p"], 4), (["o"], 4)])
    assert {r.id: r.branch for r in found.collect()} == {"1": "1", "2": "1", "3": "1", "4": "4", **{f"b{i}": f"b{i}" for i in range(5)}}


def test_keys_of_labels(spark):
    df = spark.createDataFrame([("H & R HEALTHCARE, L.P.", "Dr. Ann Lee", " tx ", "E0651"), ("H&R Healthcare L P", "Ann", "TX", "A6549"), (None, None, None, "x")], "name string, owner string, state string, code string")
    keys = df.select(L.display_key(F.col("name"), ["lp"]), L.owner_state_key(F.col("owner"), F.col("state")), L.code_in(F.col("code"), [("E", 650, 652), ("A", 6530, 6549)])).collect()
    assert [tuple(r) for r in keys] == [("h r healthcare", "ann lee|TX", True), ("h r healthcare", None, True), ("", None, False)]
    ids = spark.createDataFrame([("1", "n", "o", "p"), ("2", "n", "", "p"), ("3", None, "o", "p")], "npi string, n string, o string, p string")
    assert [r[0] for r in ids.select(L.identity_key(*[F.col(c) for c in ids.columns])).collect()] == ["group:n|o|p", "singleton:2", "singleton:3"]
    assert len({r[0] for r in ids.select(L.row_md5(*[F.col(c) for c in ids.columns])).collect()}) == 3
    days = spark.createDataFrame([("2024-01-01",), ("2024-12-31",), ("2026-01-01",), (None,)], "d string").select(L.months_old(F.col("d").cast("date"), F.lit("2025-01-01").cast("date")))
    assert [r[0] for r in days.collect()] == [12, 0, None, None]


def test_lists_texts_and_stale_codes(spark):
    df = spark.createDataFrame([("1", "Acme Health-Supply", "Ann Lee", "212-555-0100"), ("2", "Acme healthsupply", "ANN  LEE!", None), ("3", None, None, None)], "id string, name string, official string, phone string")
    on = lambda **k: {r.id for r in C.listed(df, "name", k.get("c", []), "official", k.get("o", [])).filter("listed").collect()}
    assert on(c=["health supply", ""]) == {"1"} and on(o=["ann lee"]) == {"1", "2"} and on() == set()
    found = lambda term: {r.id for r in df.filter(C.text_matches(["name", "official"], term, ["phone"])).collect()}
    assert found(" HEALTH") == {"1", "2"} and found("+1 (212) 555-0100") == {"1"} and found("_") == found("%") == set()
    codes = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    counted = spark.createDataFrame([("a", at(0)), ("a", at(10)), ("b", at(0)), (None, at(10))], "k string, at timestamp_ntz")
    assert {r.k for r in C.stale(codes, counted, "k", "at", "2024-01-01 12:00:00", 3).collect()} == {"b", "c"}
    first = spark.createDataFrame([("9",)], "n string")
    near = N.related(spark.createDataFrame([("1", "p"), ("2", "p"), ("9", "p")], "id string, k string"), "id", {"k": (["k"], 5)}, top=1, first=first)
    assert {(r.id, r.other) for r in near.collect()} == {("1", "9"), ("2", "9"), ("9", "1")}
