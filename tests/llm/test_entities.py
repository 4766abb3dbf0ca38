"""Connected sets, survivors, buildings and matches against brute force and by hand."""

import random

import pytest
from pyspark.sql import functions as F

from weir.llm import components as K
from weir.llm import queries
from weir.llm.addresses import parse_city, parse_line, parse_zip, same_building
from weir.llm.matching import cascade, name_words, names_agree, person_words, rule_confidence, with_keys
from weir.llm.spelling import cluster_spellings
from weir.llm.survivor import _by_weight, align, consensus, distance, survivors
from weir.scratch import Scratch


def sets_by_brute_force(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def sets(spark, links):
    df = spark.createDataFrame(links, "a string, b string").withColumn("src", F.lit("clash"))
    return {r.vertex: r.group for r in K.connected_sets(df).collect()}


def test_sets_like_brute_force(spark):
    rng = random.Random(1)
    name = lambda i: f"{i:05d}"
    links = [("c" + name(i), "c" + name(i + 1)) for i in range(300)]  # a sorted string
    order = rng.sample(range(200), 200)
    links += [("s" + name(a), "s" + name(b)) for a, b in zip(order, order[1:])]
    links += [("hub", "h" + name(i)) for i in range(400)] + [("h" + name(i), "t" + name(i)) for i in range(50)]
    links += [("r" + name(rng.randrange(400)), "r" + name(rng.randrange(400))) for _ in range(260)]
    links += [("x", "x"), ("y", None), (None, "y"), ("p", "q"), ("q", "p"), ("p", "q")]
    assert sets(spark, links) == sets_by_brute_force(links)


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_chains_may_be_followed_by_halves(spark, monkeypatch, share):
    monkeypatch.setattr(K, "MOVING_SHARE", share)
    links = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("h", f"c{i:03d}") for i in range(0, 60, 30)] + [("x", "y")]
    assert sets(spark, links) == sets_by_brute_force(links)


def test_sets_edges(spark):
    assert sets(spark, []) == {} == sets(spark, [("a", "a"), (None, None)])
    assert sets(spark, [("b", "a")]) == {"a": "a", "b": "a"}
    long = "z" * 50_000
    assert sets(spark, [(long, "b")]) == {long: "b", "b": "b"}


def test_links_of_groups_and_pairs(spark):
    rows = [("g", f" {i}") for i in range(200)] * 2 + [("g", None), (None, "1"), ("h", "a"), ("h", "a"), ("h", " ")]
    links = K.star_links(spark.createDataFrame(rows, "g string, v string"), "g", "v").collect()
    assert len(links) == 199
    assert sets_by_brute_force([tuple(x) for x in links]) == {str(i): "0" for i in range(200)}
    pairs = K.pair_links(spark.createDataFrame([("1", " 1 "), ("1", None), ("", "2"), ("1", "2")], "l string, r string"), "l", "r")
    assert [tuple(r) for r in pairs.collect()] == [("1", "2")]


@pytest.mark.parametrize("share", [0.0, 0.3, 0.6, 2.0])
def test_peeling_may_stop_anywhere(spark, monkeypatch, share):
    monkeypatch.setattr(K, "FRONTIER_SHARE", share)
    links = [("m", f"a{i}") for i in range(20)] + [(f"a{i}", f"b{i}") for i in range(20)] + [(f"b{i}", f"c{i}") for i in range(5)] + [("x", "y")]
    assert sets(spark, links) == sets_by_brute_force(links)


def best_of(spark, rows, weighted=False):
    df = spark.createDataFrame(rows, "g string, f string, member string, value string, rank string, w double")
    tokens = F.split("value", " ")
    found = survivors(df, Scratch(spark, "test"), tokens=tokens, weight=F.col("w") if weighted else None)
    return {(r.g, r.f): (r.member, r.value) for r in found.collect()}


def test_best_rank_decides(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(30)}", rng.choice("ab"), str(i), " ".join(rng.choice(["acme", "care", "home", "supply"]) for _ in range(rng.randrange(1, 6))), f"{rng.randrange(10**6):07d}{i}", 1.0) for i in range(300)]
    want = {}
    for g, f, m, v, r, _ in sorted(rows, key=lambda x: x[4], reverse=True):
        want[g, f] = (m, v)
    assert best_of(spark, rows) == want


def test_consensus_outvotes(spark):
    rows = [("g", "n", "1", "acme helth supply", "1", 1.5), ("g", "n", "2", "acme health supply", "2", 1.0), ("g", "n", "3", "acme health supply inc", "3", 1.0), ("h", "n", "4", "only", "1", 0.1)]
    assert best_of(spark, rows, weighted=True) == {("g", "n"): ("2", "acme health supply"), ("h", "n"): ("4", "only")}
    assert best_of(spark, rows) == {("g", "n"): ("1", "acme helth supply"), ("h", "n"): ("4", "only")}


def test_survivor_edges(spark, monkeypatch):
    assert best_of(spark, []) == {}
    assert best_of(spark, [("g", "n", "1", None, "1", 1.0), (None, "n", "1", "x", "1", 1.0)]) == {}
    monkeypatch.setattr("weir.llm.survivor.CELL", 4)  # a group of many cells and levels
    rows = [("g", "n", f"{i:03d}", f"acme v{i % 7} supply", f"{i:03d}", 1.0 + (i % 7 == 3)) for i in range(150)] + [("g", "n", "x", "b " * 3000 + "end", "999", 0.5)]
    assert best_of(spark, rows, weighted=True)[("g", "n")] == ("003", "acme v3 supply")
    assert best_of(spark, rows)[("g", "n")] == ("000", "acme v0 supply")


def test_alignment_keeps_votes():
    profile = (1.0, [{t: 1.0} for t in "a b c".split()])
    for text in ("a c", "a b x c", "b c"):
        profile = align(profile, (1.0, [{t: 1.0} for t in text.split()]), _by_weight)
    assert profile[0] == 4.0 and all(abs(sum(c.values()) - 4.0) < 1e-9 for c in profile[1])
    assert consensus(profile, max) == ["a", "b", "c"]
    assert [distance(["a", "b"], x.split()) for x in ("a b", "a", "b a", "x y z")] == [0, 1, 2, 3]


def group_tables(spark, at, members, told):
    spark.createDataFrame(members, "group_id string, npi string, relationship_type string").write.parquet(f"{at}/lead_group_members.parquet")
    spark.createDataFrame([("owner", 1), ("staff", 3), ("debtor", -1)], "relationship_type string, trust_rank int").write.parquet(f"{at}/relationship_trust.parquet")
    spark.createDataFrame(told, "npi string, name string, address_line1 string, phone string, official_phone string, last_updated string").write.parquet(f"{at}/search_providers.parquet")


def test_only_the_order_decides_who_survives(spark, tmp_path):
    import duckdb

    members = [("g", "1", "owner"), ("g", "2", "staff"), ("h", "3", "owner"), ("h", "4", "owner"), ("i", "5", "owner"), ("i", "6", "debtor"), ("j", "7", None), ("j", " 8 ", None), ("k", "1", "owner")]
    told = [
        # two rows of one date and member: aligned with each other, they would elect what the other member says
        ("1", "l nn", "Acme Supply", "212-555-0100", None, "2024-01-01"), ("1", "ll n", "Best Health", "N/A", None, "2024-01-01"), ("2", "l n", "Acme Health", "2125550101", "3125550100", "2024-01-01"),
        ("3", "Acme", "1 Elm St", None, None, "2024-01-01 08:00"), ("4", "Acme Inc", "2 Elm St", None, None, "2024-01-01 09:00"), ("5", "Acme", None, None, None, "2024-01-01"), ("6", "Acme Inc", "", None, None, None), ("7", "Acme", None, None, None, " "), ("8", "Acme", "3 Elm St", None, None, "a"),
    ]
    group_tables(spark, tmp_path, members, told)
    con = duckdb.connect()
    for t in ("lead_group_members", "relationship_trust", "search_providers"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    found = queries.p5_found(spark, str(tmp_path))
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(con.execute(queries.ORACLE["p5_found"]).fetchall())
    assert {x[:2]: x[2] for x in got if x[1] == "name"} == {("g", "name"): "1", ("h", "name"): "4", ("i", "name"): "6", ("j", "name"): "8"}
    assert "MapInArrow" not in found._jdf.queryExecution().toString()  # no stage that changes nothing


def test_words_of_a_value_vote(spark, tmp_path):
    df = spark.createDataFrame([("name", "Acme Supply, Inc."), ("name", "Caf\u00e9 No. 9"), ("name", "--"), ("phone", "(212) 555-0100")], "f string, value string")
    assert [r[0] for r in df.select(queries.value_tokens()).collect()] == [["ACME", "SUPPLY", "INC"], ["CAF\u00c9", "NO", "9"], ["--"], ["2125550100"]]
    members = [("g", "1", "owner"), ("g", "2", "staff"), ("g", "3", "staff")]
    told = [("1", "Acme Helth Supply", "1 Elm St", None, None, None), ("2", "ACME HEALTH SUPPLY", "2 Oak St", None, None, None), ("3", "Acme Health Supply", None, None, None, None)]
    group_tables(spark, tmp_path, members, told)
    assert [tuple(r) for r in queries.p5_records(spark, str(tmp_path)).collect()] == [("g", "ACME HEALTH SUPPLY", "1 Elm St", None, None)]
    assert [tuple(r) for r in queries.p5_found(spark, str(tmp_path)).orderBy("field_name").collect()] == [("g", "address_line1", "1"), ("g", "name", "1")]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("1026 W. GRAPEVINE BRIDGE CT STE 3A", ("1026", "w", "grapevinebridge", "ct")), ("NO. 1026 W GRAPEVINE BRIDGE COURT", ("1026", "w", "grapevinebridge", "ct")), ("1086 Ironwood Rd E", ("1086", "e", "ironwood", "rd")),
        ("STE F, 1322 W Bellflower Foundry Ave", ("1322", "w", "bellflowerfoundry", "ave")), ("E. Forty-Eighth ST. 3574", ("3574", "e", "48", "st")), ("1202 28 RD RM G", ("1202", "", "28", "rd")), ("1202 28TH RD", ("1202", "", "28", "rd")),
        ("106 OLEANDER MARKET, FL 813", ("106", "", "oleandermarket", "")), ("holelrick commons, 109 e lantetn drive", ("109", "e", "lantetn", "dr")), ("NO CHESTNUT LANDING CT 8346", ("8346", "n", "chestnutlanding", "ct")),
        ("3 Court", ("3", "", "court", "")), ("5886 Grapevine #6B", ("5886", "", "grapevine", "")), ("12", None), ("Main Street", None), ("", None), (None, None), ("007 first street", ("7", "", "1", "st")), ("1 " + "x" * 5000, ("1", "", "x" * 5000, "")),
    ],
)
def test_address_lines(line, want):
    assert parse_line(line) == want


def test_cities_and_codes():
    assert [parse_city(c) for c in ("FT. Kilverton, OR", "st tarnbrook", "N/A", None, "xx", "Colvern")] == ["fort kilverton", "saint tarnbrook", "", "", "", "colvern"]
    assert [parse_zip(z) for z in ("7273", "33266.0", "332668618", "00000", "12", None, "64552-9954")] == ["07273", "33266", "33266", "", "", "", "64552"]


def buildings(spark, rows):
    df = spark.createDataFrame(rows, "npi string, l string, c string, s string, z string").withColumn("id", F.lit("clash")).withColumn("street", F.lit(1))
    return sorted(tuple(r) for r in same_building(df, Scratch(spark, "test"), id="npi", line="l", city="c", state="s", postal="z").collect())


def test_same_building(spark):
    rows = [
        ("1", "12 N Oleander Market Ave", "Fort Colvern", "OK", "14792"), ("2", "12 OLEANDER MARKET AV N, STE 5", "FT COLVERN, OK", "OK", "14729"), ("3", "Rm 3 12 Oleandr Market Ave", "Fort Colvren", None, "14792-1234"),
        ("4", "12 North Oleander Market", None, "OK", "14792.0"), ("5", "12 S Oleander Market Ave", "Fort Colvern", "OK", "14792"), ("6", "12 N Oleander Market Blvd", "Fort Colvern", "OK", "14792"), ("7", "13 N Oleander Market Ave", "Fort Colvern", "OK", "14792"),
        ("8", "12 N Oleander Market Ave", "Lake Ambersett", "OK", "59871"), ("9", "N/A", "Fort Colvern", "OK", "14792"), ("10", None, "Fort Colvern", "OK", "14792"), ("11", "12 N Oleander Market Ave", None, None, None), (None, "12 N Oleander Market Ave", "Fort Colvern", "OK", "14792"),
        ("1", "12 N Oleander Market Ave", "Fort Colvern", "OK", "14792"),
    ]
    pairs = buildings(spark, rows)
    assert {("1", "2"), ("1", "4"), ("2", "4")} <= set(pairs)
    assert not {x for p in pairs for x in p} & {"6", "7", "8", "9", "10", "11"}
    assert ("1", "5") not in pairs
    assert buildings(spark, []) == []


def test_buildings_are_the_classes_of_the_pairs(spark):
    pairs = queries.p6_found(spark, "/root/testdata/sf0.001").collect()
    others = {}
    for a, b in pairs:
        others.setdefault(a, set()).add(b)
        others.setdefault(b, set()).add(a)
    rows = queries.p6_buildings(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len({r.npi for r in rows}) and {r.npi for r in rows} >= set(others)
    assert {r.npi: (r.building, r.others) for r in rows} == {r.npi: (min({r.npi} | others.get(r.npi, set())), len(others.get(r.npi, ()))) for r in rows}


def test_spellings(spark):
    rows = [("x", "oleander", 9, 9), ("x", "oleandr", 1, 1), ("x", "oelander", 2, 2), ("x", "orchard", 5, 5), ("x", "28", 9, 9), ("x", "29", 1, 1), ("y", "oleandr", 1, 1), ("x", "oleandre", 5, 5)]
    got = {(r.s, r.w): r.canonical for r in cluster_spellings(spark.createDataFrame(rows, "s string, w string, n int, o int"), "s", "w", "n", "o").collect()}
    assert got == {("x", "oleander"): "oleander", ("x", "oleandr"): "oleander", ("x", "oelander"): "oleander", ("x", "orchard"): "orchard", ("x", "28"): "28", ("x", "29"): "29", ("y", "oleandr"): "oleandr", ("x", "oleandre"): "oleandre"}


def keyed(spark, rows, id):
    df = spark.createDataFrame(rows, f"{id} string, n string, a string, p string, q string")
    return with_keys(df, "n", "a", ["p", "q"]).select(id, "full", "name_words", "whole", "partial", "first", "last", "phones")


def test_cascade(spark):
    leads = [
        ("l1", "The Acme Resp Care of Dunmarsh (ARC)", "Lee, Ann", "212-555-0100", None), ("l2", "Acme Respiratry Care", "front desk", "(212) 555-0100 ext. 4", None), ("l3", "Other Trade Name", "Dr. Ann M. Lee", "2.125550100E9", None),
        ("l4", "Acme Respiratory Care", "Bo Ray", "3125550100", None), ("l5", "Unknown Org", "Bo Ray", "2125550100", None), ("l6", "Acme Respiratory", "A. Lee", None, None), ("l7", None, None, None, None), ("l8", "N/A", "", "0000000000", None),
    ]
    candidates = [("c1", "ACME RESPIRATORY CARE LLC", "ANN LEE", "12125550100", None), ("c2", "ACME RESPIRATORY CARE INC", "CY FOX", "4125550100", None), ("c1", "ACME RESPIRATORY CARE LLC", "ANN LEE", "9", "2125550100.0"), ("c3", None, None, None, None)]
    found = cascade(keyed(spark, leads, "lead"), keyed(spark, candidates, "cand"), Scratch(spark, "test"), lead="lead", candidate="cand")
    got = {r.lead: (r.cand, r.rule) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {"l1": "c1", "l2": "c1", "l3": "c1", "l6": "c1"}
    assert got["l1"][1] == "phone, name" and got["l3"][1] == "phone, person"
    labels = spark.createDataFrame([("l1", "c1", True), ("l2", "c1", False)], "lead string, cand string, is_match boolean")
    sure = {r.rule: r.confidence for r in rule_confidence(found, labels, lead="lead", candidate="cand").collect()}
    assert sure["phone, name"] == round((1 + 7) / 11, 4) and sure["phone, person"] == 0.7
    none = cascade(keyed(spark, [], "lead"), keyed(spark, candidates, "cand"), Scratch(spark, "test"), lead="lead", candidate="cand")
    assert none.count() == 0


def test_rows_that_say_the_same_meet_once(spark):
    leads = [(f"l{i:03d}", "Acme Care", "Ann Lee", "2125550100", None) for i in range(300)] + [("other", "Acme Care", "Bo Ray", "2125550100", None)]
    candidates = [(f"c{i:03d}", "ACME CARE LLC", "ANN LEE", "2125550100", None) for i in range(300)] + [("c", "Acme Care", "Bo Ray", "2125550100", "3125550100")]
    found = cascade(keyed(spark, leads, "lead"), keyed(spark, candidates, "cand"), Scratch(spark, "test"), lead="lead", candidate="cand")
    assert {r.lead: r.cand for r in found.collect()} == {f"l{i:03d}": "c000" for i in range(300)} | {"other": "c"}


def test_names_and_persons(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).collect()[0][0]

    assert one(name_words, "Stenenter & Fenalbelson Orthotics &") == ["stenenter", "fenalbelson", "orthotics"]
    assert one(name_words, "Ortho Med Svcs L.L.C. of X of Y") == ["orthotics", "medical", "services"]
    assert one(name_words, "House of Oxygen") == ["house", "oxygen"] and one(name_words, "House of Mobility LLC") == ["house", "mobility"]
    assert one(name_words, "--") is None and one(name_words, None) is None
    assert one(person_words, "RILEY, ANN (OWNER)") == ["ann", "riley"] and one(person_words, "front desk") is None and one(person_words, "Ann Lee M.D.") == ["ann", "lee"]
    df = spark.createDataFrame([("acme home medical", "acme home medical equipment"), ("acme hmoe medical", "acme home medical"), ("acme", "apex")], "x string, y string")
    assert [r[0] for r in df.select(names_agree("x", "y")).collect()] == [True, True, False]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    assert len(rows) == len({str(r) for r in rows})
    if name in queries.ORACLE:
        import duckdb

        con = duckdb.connect()
        for t in ("registry_match_candidates", "lead_group_members", "search_providers", "relationship_trust", "documents"):
            con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
        want = con.execute(queries.ORACLE[name]).df()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, want[df.columns].values))
