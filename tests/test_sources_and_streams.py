"""Release files, mutations of snapshots, scalar rules, and the event stream."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from weir.functions import calls as P
from weir.functions import labels as L
from weir.functions import pages as G
from weir.functions import text as X
from weir.operators import activity as V
from weir.operators import apply as A
from weir.operators import criteria as C
from weir.sources import files as Z
from weir.sources import release as R
from weir.sources import sheets as H
from weir.streaming import events as S

HEADER = "NPI,Entity Type Code,Provider Organization Name (Legal Business Name),provider first name,Provider Last Name (Legal Name),Provider Business Practice Location Address State Name,Provider Business Practice Location Address Telephone Number,Healthcare Provider Taxonomy Code_1,Healthcare Provider Primary Taxonomy Switch_1,Healthcare Provider Taxonomy Code_2,Healthcare Provider Primary Taxonomy Switch_2,Last Update Date,NPI Deactivation Date,NPI Reactivation Date"
ROWS = [
    '1234567893,2,"Acme, Supply Inc",,,texas,"(1) 212 555 0100 / 3125550101",A1,N,B2,Y,03/04/2024,,',
    "1234567893,2,Acme again,,,TX,,A1,Y,,,,,",
    "1234567890,2,Bad digit,,,TX,,A1,Y,,,,,",
    "123,2,Short,,,TX,,A1,Y,,,,,",
    ",2,No number,,,TX,,A1,Y,,,,,",
    "1245319599,1,,Ann,Lee,TX,,A1,Y,,,,,",
    "1245319599,2,,,,TX,,A1,Y,,,2024-01-02,,",
    "1245319599,2,Late but first accepted,,,TX,,A1,Y,,,2024-01-02,02/01/2024,01/01/2024",
]


@pytest.fixture
def release(tmp_path):
    path = tmp_path / "release.csv"
    path.write_text("\n".join([HEADER, *ROWS]) + "\n")
    return str(path)


def test_release_ingest(spark, release, tmp_path):
    manifest = R.ingest(spark, release, str(tmp_path / "out"), "run1", states=["TX", "TE"])
    assert {k: manifest[k] for k in ("run", "rows", "accepted", "rejected", "status")} == {
        "run": "run1", "rows": 8, "accepted": 2, "rejected": {"bad_check_digit": 1, "bad_format": 1, "duplicate": 1, "individual": 1, "missing_name": 1, "missing_npi": 1}, "status": "staged",
    }
    staged = {r.name: r for r in spark.read.parquet(str(tmp_path / "out/staging")).collect()}
    acme = staged["Acme, Supply Inc"]
    assert (acme.taxonomy_code, acme.taxonomy_codes, acme.state, acme.normalized_name, acme.last_updated) == ("B2", ["A1", "B2"], "TE", "ACME SUPPLY INC", dt.date(2024, 3, 4))
    assert staged["Late but first accepted"].status == "deactivated"
    assert json.loads(spark.read.text(str(tmp_path / "out/manifest/run1")).collect()[0][0])["accepted"] == 2
    rejects = spark.read.option("header", True).csv(str(tmp_path / "out/rejects/run1")).collect()
    assert {(r.source_row, r.detail) for r in rejects} >= {("3", "an earlier row of this NPI was accepted"), ("7", "not an organization")} and len(rejects) == 6
    applied = spark.createDataFrame([(manifest["checksum"],)], "checksum string")
    with pytest.raises(ValueError, match="applied already"):
        R.ingest(spark, release, str(tmp_path / "out"), "run2", applied=applied)
    assert R.ingest(spark, release, str(tmp_path / "out"), "run2", applied=applied, again=True, states=["TX", "TE"])["accepted"] == 2
    with pytest.raises(ValueError, match="1 of 2"):
        R.finish(spark, str(tmp_path / "out"), "run1", 1)
    assert R.finish(spark, str(tmp_path / "out"), "run1", 2)["status"] == "applied"
    with pytest.raises(ValueError, match="applied"):
        R.abort(spark, str(tmp_path / "out"), "run1", "late")
    assert R.abort(spark, str(tmp_path / "out"), "run2", " wrong file ")["why"] == "wrong file"
    assert spark.read.parquet(str(tmp_path / "out/staging")).select("refresh_run_id").distinct().collect() == [("run1",)]


def test_headers_and_guards(spark, release):
    assert R.resolve_headers(["﻿npi", "LAST-name", "Last Name"]) == {"npi": "﻿npi", "last_name": "LAST-name"}
    with pytest.raises(ValueError):
        R.resolve_headers(["name"])
    assert [R.separator_of(x) for x in ("a;b;c,d", "a\tb", "a")] == [";", "\t", ","]
    R.check_count(98, 100, 2)
    with pytest.raises(ValueError):
        R.check_count(97, 100, 2)
    df = R.scan(spark, release)
    assert R.content_checksum(df.drop("source_row")).collect() == R.content_checksum(df.drop("source_row").repartition(5)).collect()


def test_rows_are_numbered_by_their_place(spark, tmp_path):
    lines = ["NPI,NPPES Deactivation Date"] + [f"{i:010d},01/{1 + i % 28:02d}/2024" for i in range(3000)]
    (tmp_path / "gone.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = R.scan(spark, str(tmp_path / "gone.csv"))
        assert df.rdd.getNumPartitions() > 2
        rows = R.deactivations(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.source_row, r.npi) for r in rows) == [(i + 2, f"{i:010d}") for i in range(3000)]
    assert {r.status for r in rows} == {"deactivated"} and rows[0].deactivation_date.year == 2024
    (tmp_path / "quoted.csv").write_text('NPI,Organization Name\n1,"two\nlines"\n2,b\n')
    quoted = R.scan(spark, str(tmp_path / "quoted.csv"), multi_line=True)
    assert [(r.source_row, r.NPI) for r in quoted.orderBy("source_row").collect()] == [(2, "1"), (3, "2")]


def test_files_and_catalogues(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\ny")
    (tmp_path / "b.txt").write_bytes(b"z\n")
    facts = {r.path.rsplit("/", 1)[1]: r for r in Z.file_facts(spark, str(tmp_path / "*.txt")).collect()}
    assert (facts["a.txt"].lines, facts["b.txt"].lines, facts["a.txt"].size) == (2, 1, 3) and facts["a.txt"].checksum == hashlib.sha256(b"x\ny").hexdigest()
    assert sorted(r.fingerprint.rsplit(":", 1)[0] for r in Z.file_fingerprints(spark, str(tmp_path / "*.txt")).collect()) == ["nohash:a.txt:3", "nohash:b.txt:2"]
    uuid = "01234567-89ab-cdef-0123-456789abcde{}".format
    entry = lambda i, period, note: {"title": f"Data {period}", "temporal": period, "accessURL": f"https://x/data-api/v1/dataset/{uuid(i)}/data", "downloadURL": None, "description": note}
    catalog = {"dataset": [{"title": "Supplies : 2023", "distribution": [entry(1, "2023-01-01/2023-12-31", None), entry(2, "2024-01-01/2024-12-31", None), entry(3, "2024-01-01/2024-12-31", "latest")]}, {"title": "Other", "distribution": [entry(4, "2025", "latest")]}]}
    df = spark.createDataFrame([(json.dumps(catalog),)], "j string").select(F.from_json("j", Z.CATALOG).alias("c")).select("c.*")
    assert [tuple(r) for r in Z.newest_distribution(df, "supplies").collect()] == [(uuid(3), "Data 2024-01-01/2024-12-31", 2024)]
    assert Z.newest_distribution(df, "none").count() == 0
    assert one(spark, Z.reported_rows(F.col("v")), v='{"a": {"total_rows": 7, "x": [{"rowCount": 12}]}, "n": 99}') == 12 and one(spark, Z.reported_rows(F.col("v")), v="{}") is None
    cells = spark.createDataFrame([("=1+1", ["a", "b"], 'say "x"')], "a string, b array<string>, c string")
    Z.write_cells(cells, str(tmp_path / "cells"))
    assert next((tmp_path / "cells").glob("*.csv")).read_bytes() == b'a,b,c\r\n\'=1+1,a; b,"say ""x"""\r\n'


def test_paged_json(spark, tmp_path):
    for i, rows in enumerate(([{"n": 1}, {"n": 2}], [{"n": 3}])):
        (tmp_path / f"{2 * i}.json").write_text(json.dumps(rows))
    spark.dataSource.register(Z.PagedJson)
    read = lambda **o: sorted(map(tuple, spark.read.format("paged_json").options(url=f"file://{tmp_path}/{{offset}}.json", size="2", tries="2", pause="0", **o).load().collect()))
    assert read() == read(total="3") == [(0, '{"n": 1}'), (1, '{"n": 2}'), (2, '{"n": 3}')]
    with pytest.raises(Exception, match="No such file|not exist|URLError"):
        read(total="5")


def test_sheets(spark):
    columns = H.columns_by_pattern(["\ufeffNPI", "Company  Name", "Opener", "x"], {"npi": "^npi$", "company": r"^company(\s*name)?$", "opener": "^opener$", "sub": "^sub$"})
    assert columns == {"npi": "\ufeffNPI", "company": "Company  Name", "opener": "Opener"}
    rows = [(1, "123456789", "a", None), (2, "1234567890", "Solar", None), (3, "1234567890", "b", "yes"), (4, "123-456-7890", "c", None), (5, "1234567890", "d", None), (6, "1111111111", "george co", None)]
    df = spark.createDataFrame(rows, "row int, npi string, sub string, sync string")
    got = H.qualified(df, "row", "npi", excluded={"sub": ["solar"]}, words=["George"], done=F.col("sync").rlike("(?i)^(yes|true)$"))
    assert {r.row: r.reason for r in got.collect()} == {1: "invalid", 2: "excluded", 3: "done", 4: None, 5: "duplicate", 6: "excluded"}


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr).collect()[0][0]


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [
        (X.clean_text, "  a \t b ", "a b"), (X.clean_text, "  ", None), (X.normalize_name, "O'Neil & Sons", "O NEIL SONS"), (X.name_key, "Acme Supply, L.L.C.", "acme supply"), (X.name_key, None, ""),
        (X.postal_code, "12345-6789", "12345-6789"), (X.postal_code, "123456", "12345"), (X.postal_code, "x", None), (L.building_key, "12 Main St, Suite 5", "12 MAIN ST"), (L.building_key, "Main St", None), (L.building_key, "Lot 12 Main St Dept 4", "LOT 12 MAIN ST"),
        (X.national_number, "1 (212) 555-0100", "2125550100"), (X.national_number, "212555010", None), (X.formula_safe, "=A1", "'=A1"), (X.formula_safe, "-12.5", "-12.5"), (X.formula_safe, "+1 212", "'+1 212"),
        (P.call_time, "2026-10-07T19:40Z", dt.datetime(2026, 10, 7, 19, 40)), (P.call_time, "10/7/2026 12:05 AM", dt.datetime(2026, 10, 7, 0, 5)), (P.call_time, "2026-10-07 19:40:12 -0530", dt.datetime(2026, 10, 8, 1, 10, 12)), (P.call_time, "2026-10-07", dt.datetime(2026, 10, 7)), (P.call_time, "2026-13-07", None), (P.call_time, "soon", None),
        (P.duration_seconds, "95.5", 96), (P.duration_seconds, "1:35", 95), (P.duration_seconds, "01:01:35", 3695), (P.duration_seconds, "1:5", None), (P.zone_of_state, " tx ", "America/Chicago"), (P.zone_of_state, "ZZ", None),
        (L.plain_label, " Señor_VM/left -- ok!", "senor vm left ok"), (L.plain_label, None, ""), (L.tag, " Call  After 2PM!", "call after 2pm"), (L.tag, "x" * 25, None), (L.owner_key, "Dr. Ann-Lee, MD (owner)", "ann lee"), (L.suite_of, "12 Main st., ste  a", "STE A"), (L.suite_of, "12 Main", ""),
        (L.category_name, "DME-Orthotic Devices", "Orthotic Devices"), (L.category_name, None, "Other"), (L.dated_id, "o20151130001936", "2015-11-30"), (L.dated_id, "O20151330001936", None), (L.whole_number, "1,234.9", 1234), (L.whole_number, "x", None), (L.number_or_zero, "x", 0.0),
        (G.emails, "A@b.co, a@B.co logo@2x.png", ["a@b.co"]), (G.phones, "call (212) 555-0100 or +1 212.555.0101", ["(212) 555-0100", "+1 212.555.0101"]), (G.phones, None, []), (G.text_lines, "<p>a&nbsp;b</p> <br/>c &amp; d", ["a b", "c & d"]),
        (X.parse_date, "2/30/2024", None), (X.parse_date, "20240229", dt.date(2024, 2, 29)), (X.parse_number, "1,234.5", 1234.5), (X.parse_number, "n/a", None),
        (X.check_digit_ok, "1234567893", True), (X.check_digit_ok, "1234567890", False), (X.check_digit_ok, "12345", False), (X.check_digit_ok, None, None), (X.first_phone, "0125550100 12125550101", None),
    ],
)
def test_scalar_rules(spark, expr, value, want):
    assert one(spark, expr(F.col("v")), v=value) == want


def test_phone_keys(spark):
    assert one(spark, X.phone_key(F.col("a"), F.col("b")), a="12", b="1-212-555-0100") == "2125550100"
    assert one(spark, X.phone_key(F.col("a"), F.col("b")), a=None, b=None) == ""
    assert one(spark, X.first_phone(F.col("a"), F.col("b")), a="none", b="(212) 555-0100") == "2125550100"
    assert one(spark, X.official_key(F.col("a"), F.col("b")), a="Ann B.", b="O'Lee") == "ann olee"


def test_apply_and_upsert(spark):
    live = spark.createDataFrame([("1", "active", "5550100", None), ("2", "active", "x", None)], "npi string, status string, phone string, deactivation_date string")
    staged = spark.createDataFrame([("1", "A", "555.0100", None), ("3", "active", None, None)], live.schema)
    both = A.compared(live, staged, "npi", ["status", "phone"])
    assert {r.npi: r.action for r in A.classify(both, ["status", "phone"]).collect()} == {"1": "unchanged", "2": "absent", "3": "inserted"}
    assert [r.field_name for r in A.field_history(both, "npi", ["status", "phone"]).collect()] == ["record_created"]
    assert {r.npi for r in A.upserted(live, staged, "npi").collect()} == {"1", "2", "3"}
    off = A.deactivated(live, spark.createDataFrame([("2", "2024-05-01"), ("9", "2024-05-01")], "npi string, deactivation_date string"), "npi", "deactivation_date")
    assert {(r.npi, r.status, r.deactivation_date) for r in off.collect()} == {("1", "active", None), ("2", "deactivated", "2024-05-01")}


def test_criteria_short_cuts(spark):
    row = ("1", "100% Care_", None, "NPI-2", None, None, "212-555-0100", None, "CA", "T", None, None, None, None)
    names = "npi name is_organization enumeration_type status deactivation_date phone official_phone state taxonomy_code city official_first_name official_last_name postal_code".split()
    df = spark.createDataFrame([row], ", ".join(f"{n} {'boolean' if n == 'is_organization' else 'string'}" for n in names)).withColumn("last_updated", F.lit("2024-05-01")).withColumn("medicare_total_claims", F.lit(None).cast("double"))
    hit = lambda c: df.filter(C.predicate(c)).count()
    assert hit({}) == hit({"npi": "1", "state": "TX"}) == hit({"phone": "2125550100", "state": "TX"}) == hit({"q": "100"}) == hit({"organizationName": "100*care"}) == 1
    assert hit({"state": "TX"}) == hit({"lastUpdatedYears": ["24", "x"]}) == hit({"activeMedicare": True}) == hit({"excludeKeywords": ["care"]}) == hit({"q": "x' or 1=1 --"}) == 0
    assert hit({"zipPrefix": "12"}) == hit({"lastUpdatedYears": ["2024"]}) == 1


def test_pairing_by_hand(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=m)
    rows = [(1, at(0), "call"), (2, at(5), "dial"), (3, at(10), "call"), (4, at(12), "call"), (5, at(20), "dial"), (6, at(51), "call"), (7, at(60), "dial"), (8, at(61), "dial"), (9, at(91), "call")]
    df = spark.createDataFrame([("u", *r) for r in rows], "who string, id int, at timestamp, kind string")
    kept = V.calls_once(df, ["who"], "at", "id", F.col("kind") == "dial", F.col("kind") == "call")
    assert sorted(r.id for r in kept.collect() if r.kind == "call") == [1, 4, 6]


def test_note_lines(spark):
    text = "2024-01-02 10:00 — Ann Lee: Dialed\n nonsense\n2024-01-02 25:00: Meeting booked\n2024-01-03 09:30: x: y"
    colon = V.note_lines(spark.createDataFrame([(1, "2024-01-02 10:00 — Ann: Lee x: Dialed")], "id int, t string"), "id", "t").collect()[0]
    assert (colon.author, colon.note) == ("Ann", "Lee x: Dialed")
    rows = V.note_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t").collect()
    assert [(r.line, r.author, r.note, r.kind, r["at"] is None) for r in rows] == [(0, "Ann Lee", "Dialed", "dial", False), (2, None, "Meeting booked", "booked", True), (3, None, "x: y", "call", False)]


def run(stream, name, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def test_stream_counts_and_pairing(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=m)
    first = [(1, at(0), 7, "click", 1.0, None), (2, at(10), 7, "view", 1.0, None), (2, at(10), 7, "view", 1.0, None), (3, at(12), 7, "view", 1.0, None), (9, dt.datetime(2099, 1, 1), 7, "view", 1.0, None)]
    second = [(4, at(20), 7, "click", 1.0, None), (5, at(60), 7, "view", 1.0, None)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, S.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = S.watermarked(S.plausible(S.event_stream(spark, str(tmp_path / "in/*")), "2024-02-01 00:00:00"))
    kept = run(S.paired_calls(S.once(source)), "paired")
    assert sorted(r.ts for r in kept.collect()) == [at(12), at(60)]
    counted = run(S.windowed_counts(source, "1 hour"), "counted", "update")
    assert max(r.n for r in counted.filter("event_type = 'view'").collect()) == 3


def test_stream_upsert(spark, tmp_path):
    path = str(tmp_path / "latest")
    upsert = S.upsert_each_batch(path, ["k"], "at")
    schema = "k string, at int, v string"
    upsert(spark.createDataFrame([("a", 1, "x"), ("b", 5, "y"), ("c", 1, "c")], schema), 0)
    kept = {f for f in (tmp_path / "latest/table").rglob("*.parquet")}
    for _ in range(2):  # the second time it is run again
        upsert(spark.createDataFrame([("a", 2, "z"), ("b", 4, "old")], schema), 1)
    upsert(spark.createDataFrame([], schema), 2)
    rows = spark.read.parquet(f"{path}/table").select("k", "at", "v").collect()
    assert sorted(map(tuple, rows)) == [("a", 2, "z"), ("b", 5, "y"), ("c", 1, "c")]
    assert kept & {f for f in (tmp_path / "latest/table").rglob("*.parquet")}, "buckets without a key of the batch stay as they are"


def test_pages(spark):
    page = '<h1>Team</h1><p>Ann Lee</p><p>Office Manager</p><p>Bo Ray, Owner</p><a class="x" href="/staff">Our <b>staff</b></a><a href="mailto:a@b.co">mail</a>'
    assert [tuple(p) for p in one(spark, G.people(F.col("v"), "owner|manager"), v=page)] == [("Ann Lee", "Office Manager"), ("Bo Ray", "Owner")]
    assert [tuple(p) for p in one(spark, G.links(F.col("v")), v=page)] == [("/staff", "Our  staff")] or [p.href for p in one(spark, G.links(F.col("v")), v=page)] == ["/staff"]
    assert one(spark, G.people(F.col("v"), "owner"), v=None) == [] == one(spark, G.links(F.col("v")), v=None)


def test_answers_and_windows(spark):
    df = spark.createDataFrame([(20, "Left voicemail"), (1, "Talked"), (15, None), (14, ""), (None, None)], "s int, d string")
    assert [r[0] for r in df.select(P.answered(F.col("s"), F.col("d"))).collect()] == [False, True, True, False, False]
    at = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), "America/New_York") for h in (13, 14, 17, 22)] + [(dt.datetime(2024, 1, 6, 15), "America/New_York")], "t timestamp_ntz, z string")
    assert [r[0] for r in at.select(P.calling_window(P.local_time(F.col("t"), F.col("z")))).collect()] == ["before", "open", "lunch", "after", "weekend"]


def test_labels_are_settled(spark):
    rules, junk = [("voicemail", "^(vm|voice ?mail)$"), ("new", "^new$")], ["tbd"]
    df = spark.createDataFrame([("VM",), ("new",), ("xx",), ("TBD",), ("Site  Visit",), ("site visit",), (None,), ("12345",)], "v string")
    got = [tuple(r[0]) for r in df.select(L.settled_label(F.col("v"), rules, junk)).collect()]
    assert got == [("voicemail", "same meaning"), ("new", "ok"), (None, "meaningless"), (None, "meaningless"), ("site visit", "tidy spelling"), ("site visit", "custom"), (None, "meaningless"), (None, "meaningless")]


def test_criteria_are_cleaned():
    request = {"hasPhone": "on", "untouched": "no", "states": [" CA", "", "CA", "TX"], "state": "x", "taxonomyCode": "A1", "q": "a%_ b,", "phone": "+1 (212) 555-0100", "zipPrefix": "12", "minMedicareClaims": "0", "sort": "Name", "tag": " Big ", "other": 1}
    assert C.cleaned(request) == {"hasPhone": True, "states": ["CA", "TX"], "taxonomyCodes": ["A1"], "tag": "big", "q": "a b", "phone": "2125550100", "sort": "name"}
    assert C.cleaned({"specialty": "None of these"})["taxonomyCodes"] == [C.NO_CODE]
    a, b = {"states": ["CA", "TX"], "hasPhone": True}, {"hasPhone": True, "states": ["TX", "CA"], "sort": "npi"}
    assert C.fingerprint(a) == C.fingerprint(b) != C.fingerprint({"states": ["CA"]})
