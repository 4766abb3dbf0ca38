"""Registry releases: delimited files with changing headers, to staged rows, rejects and a manifest."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.functions.text import check_digit_ok, clean_text, first_phone, normalize_name, parse_date, postal_code
from weir.operators.apply import validated

#: Spellings of the release's headers by the staged column.
HEADERS = {
    "npi": ["NPI"],
    "entity_type": ["Entity Type Code"],
    "replacement_npi": ["Replacement NPI"],
    "organization_name": ["Provider Organization Name (Legal Business Name)", "Organization Name"],
    "last_name": ["Provider Last Name (Legal Name)", "Last Name"],
    "first_name": ["Provider First Name", "First Name"],
    "middle_name": ["Provider Middle Name", "Middle Name"],
    "address_line1": ["Provider First Line Business Practice Location Address", "Address Line 1"],
    "address_line2": ["Provider Second Line Business Practice Location Address", "Address Line 2"],
    "city": ["Provider Business Practice Location Address City Name", "City"],
    "state": ["Provider Business Practice Location Address State Name", "State"],
    "postal_code": ["Provider Business Practice Location Address Postal Code", "Postal Code"],
    "phone": ["Provider Business Practice Location Address Telephone Number", "Phone"],
    "fax": ["Provider Business Practice Location Address Fax Number", "Fax"],
    "official_last_name": ["Authorized Official Last Name"],
    "official_first_name": ["Authorized Official First Name"],
    "official_title": ["Authorized Official Title or Position"],
    "official_phone": ["Authorized Official Telephone Number"],
    "enumeration_date": ["Provider Enumeration Date"],
    "last_updated": ["Last Update Date"],
    "deactivation_date": ["NPI Deactivation Date", "NPPES Deactivation Date"],
    "reactivation_date": ["NPI Reactivation Date"],
    "certification_date": ["Certification Date"],
}
DATES = ["enumeration_date", "last_updated", "deactivation_date", "reactivation_date", "certification_date"]


def plain_header(header: str) -> str:
    return re.sub("[^a-z0-9]", "", header.lower().lstrip("﻿"))


def resolve_headers(columns: list[str], wanted: dict[str, list[str]] = HEADERS) -> dict[str, str]:
    """Staged column to the file's column; spelling, case and punctuation aside, the first spelling that occurs wins."""
    present: dict[str, str] = {}
    for column in columns:
        present.setdefault(plain_header(column), column)
    found = {name: next((present[plain_header(s)] for s in spellings if plain_header(s) in present), None) for name, spellings in wanted.items()}
    if not found.get("npi"):
        raise ValueError("the file has no NPI column")
    return {name: column for name, column in found.items() if column}


def slots(columns: list[str], stem: str) -> list[str]:
    """The columns stem_1, stem_2 ... of a repeated group, in order of their number."""
    numbered = [(int(m.group(1)), c) for c in columns if (m := re.fullmatch(re.escape(plain_header(stem)) + r"(\d+)", plain_header(c)))]
    return [c for _, c in sorted(numbered)]


def separator_of(first_line: str) -> str:
    """The most frequent of comma, semicolon and tab; a comma if there is none."""
    return max(",;\t", key=lambda s: (first_line.count(s), s == ","))


def numbered(df: DataFrame, column: str, first: int = 0) -> DataFrame:
    """df with the number of each row in the order of its partitions, without gaps, from `first` on.

    Rows of each partition are counted in one pass and numbered behind those before in a second; df must be read alike both
    times, as files are. Only one row a partition is sorted in one place.
    """
    placed = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftrightunsigned("__id", 33))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(starts, "__part").withColumn(column, F.col("__start") + inside + first).drop("__id", "__part", "__start")


def scan(spark: SparkSession, path: str, sep: str | None = None, *, multi_line: bool = False) -> DataFrame:
    """A delimited file with its rows as text, and source_row: the number of the row in the file, where the header is 1.

    Files are split and read in parallel. Quoted cells that hold line ends need multi_line, which reads a file in one task;
    without it such a cell breaks its row in two. Rows are counted, not the lines of a row nor blank lines.
    """
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        sep = separator_of(first[0][0] if first else "")
    df = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("mode", "PERMISSIVE").option("multiLine", multi_line).csv(path)
    return numbered(df, "source_row", 2)


def deactivations(df: DataFrame) -> DataFrame:
    """(source_row, npi, status, deactivation_date) of a deactivation file, which says nothing of any other field."""
    columns = resolve_headers(df.columns, {k: HEADERS[k] for k in ("npi", "deactivation_date")})
    date = parse_date(F.col(f"`{columns['deactivation_date']}`")) if "deactivation_date" in columns else F.lit(None).cast("date")
    return df.select("source_row", F.trim(F.col(f"`{columns['npi']}`")).alias("npi"), F.lit("deactivated").alias("status"), date.alias("deactivation_date"))


def staged(df: DataFrame) -> DataFrame:
    """Rows of a release in staged form: headers resolved, texts, phones, codes and dates normalized, taxonomy codes as an array."""
    columns = resolve_headers(df.columns)
    cell = lambda name: F.col(f"`{columns[name]}`") if name in columns else F.lit(None).cast("string")
    codes = slots(df.columns, "Healthcare Provider Taxonomy Code_")
    switches = slots(df.columns, "Healthcare Provider Primary Taxonomy Switch_")
    pairs = F.array(*[F.struct(clean_text(F.col(f"`{c}`")).alias("code"), (F.upper(F.trim(F.col(f"`{s}`"))) == "Y").alias("primary")) for c, s in zip(codes, switches)])
    known = F.filter(pairs, lambda p: p["code"].isNotNull())
    primary = F.coalesce(F.get(F.filter(known, lambda p: p["primary"]), F.lit(0)), F.get(known, F.lit(0)))
    person = clean_text(F.concat_ws(" ", cell("first_name"), cell("middle_name"), cell("last_name")))
    name = F.coalesce(clean_text(cell("organization_name")), person)
    dates = {d: parse_date(cell(d)) for d in DATES}
    off = dates["deactivation_date"].isNotNull() & F.coalesce(dates["reactivation_date"] < dates["deactivation_date"], dates["reactivation_date"].isNull())
    return df.select(
        "source_row", F.trim(cell("npi")).alias("npi"), name.alias("name"), normalize_name(name).alias("normalized_name"),
        F.when(F.trim(cell("entity_type")).isin("1", "2"), F.concat(F.lit("NPI-"), F.trim(cell("entity_type")))).alias("enumeration_type"),
        (F.trim(cell("entity_type")) == "2").alias("is_organization"), F.when(off, "deactivated").otherwise("active").alias("status"),
        *[clean_text(cell(c)).alias(c) for c in ("address_line1", "address_line2", "city", "official_first_name", "official_last_name", "official_title", "replacement_npi")],
        F.left(F.upper(F.trim(cell("state"))), F.lit(2)).alias("state"), postal_code(cell("postal_code")).alias("postal_code"),
        first_phone(cell("phone")).alias("phone"), first_phone(cell("fax")).alias("fax"), first_phone(cell("official_phone")).alias("official_phone"),
        (primary["code"] if codes else F.lit(None).cast("string")).alias("taxonomy_code"),
        (F.transform(known, lambda p: p["code"]) if codes else F.array().cast("array<string>")).alias("taxonomy_codes"),
        *[v.alias(d) for d, v in dates.items()],
    )


def npi_rules(npi: Column) -> list[tuple[str, Column]]:
    return [("missing_npi", npi.isNull() | (npi == "")), ("bad_format", ~npi.rlike("^[0-9]{10}$")), ("bad_check_digit", ~check_digit_ok(npi))]


def row_rules(*, taxonomies: list[str] | None = None, states: list[str] | None = None, keywords: list[str] | None = None, organizations_only: bool = True) -> list[tuple[str, Column]]:
    """The rules of a release in order, over staged columns; keywords are words of the name of which one must occur."""
    rules = [("missing_name", F.col("name").isNull() | (F.trim("name") == ""))]
    if organizations_only:
        rules.append(("individual", ~F.coalesce("is_organization", F.lit(True))))
    if keywords:
        rules.append(("keyword", ~F.col("normalized_name").rlike("|".join(re.escape(k.upper()) for k in keywords))))
    if states:
        rules.append(("state", ~F.coalesce(F.upper(F.trim("state")).isin(states), F.lit(False))))
    if taxonomies:
        rules.append(("taxonomy", ~F.arrays_overlap("taxonomy_codes", F.array(*map(F.lit, taxonomies)))))
    return rules


#: What each reason for a rejection means, for the rejects file.
DETAILS = {
    "missing_npi": "no NPI", "bad_format": "not ten digits", "bad_check_digit": "the check digit is wrong", "duplicate": "an earlier row of this NPI was accepted", "missing_name": "no name",
    "individual": "not an organization", "keyword": "no wanted word in the name", "state": "another state", "taxonomy": "no wanted taxonomy",
}


def ingest(spark: SparkSession, path: str, out: str, run: str, *, multi_line: bool = False, applied: DataFrame | None = None, again: bool = False, **rules) -> dict:
    """Stages a release under out/staging/refresh_run_id=run, its rejects under out/rejects, and returns and writes the manifest.

    The manifest names rows, accepted and rejected by reason, the rules, a checksum of the rows that doesn't depend on their
    order, and the status. applied has the `checksum` of each release applied so far: the same rows again are refused,
    unless `again`.
    """
    rows = scan(spark, path, multi_line=multi_line)
    checksum = content_checksum(rows.drop("source_row")).collect()[0]["checksum"]  # one row
    if applied is not None and not again and not applied.filter(F.col("checksum") == checksum).isEmpty():
        raise ValueError("a release of the same rows was applied already")
    checked = validated(staged(rows), "npi", "source_row", npi_rules(F.col("npi")), row_rules(**rules))
    checked.write.mode("overwrite").partitionBy("reason").parquet(f"{out}/checked/{run}")
    kept = spark.read.schema(checked.schema).parquet(f"{out}/checked/{run}")
    kept.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{out}/staging/refresh_run_id={run}")
    detail = F.create_map(*[F.lit(x) for pair in DETAILS.items() for x in pair])[F.col("reason")]
    kept.filter("reason is not null").select("source_row", "npi", "reason", detail.alias("detail"), "name").write.mode("overwrite").option("header", True).csv(f"{out}/rejects/{run}")
    by_reason = {r["reason"] or "accepted": r["n"] for r in kept.groupBy("reason").agg(F.count("*").alias("n")).collect()}  # one row a rule
    manifest = {"run": run, "rows": sum(by_reason.values()), "accepted": by_reason.pop("accepted", 0), "rejected": dict(sorted(by_reason.items())), "rules": rules, "checksum": checksum, "status": "staged"}
    write_manifest(spark, out, manifest)
    return manifest


def write_manifest(spark: SparkSession, out: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest/{manifest['run']}")


def read_manifest(spark: SparkSession, out: str, run: str) -> dict:
    return json.loads(spark.read.text(f"{out}/manifest/{run}").collect()[0][0])  # one row


def finish(spark: SparkSession, out: str, run: str, applied_rows: int) -> dict:
    """Marks a staged run as applied; raises unless as many rows were applied as were staged."""
    manifest = read_manifest(spark, out, run)
    if manifest["status"] != "staged":
        raise ValueError(f"run {run} is {manifest['status']}")
    if applied_rows != manifest["accepted"]:
        raise ValueError(f"{applied_rows} of {manifest['accepted']} rows were applied")
    write_manifest(spark, out, done := manifest | {"status": "applied"})
    return done


def abort(spark: SparkSession, out: str, run: str, reason: str) -> dict:
    """Drops the staged rows of a run that wasn't applied, and keeps why in its manifest."""
    manifest = read_manifest(spark, out, run)
    if manifest["status"] != "staged":
        raise ValueError(f"run {run} is {manifest['status']}")
    if not reason.strip():
        raise ValueError("say why")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/staging/refresh_run_id={run}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    write_manifest(spark, out, done := manifest | {"status": "aborted", "why": reason.strip()})
    return done


def check_count(actual: int, expected: int, tolerance_pct: float) -> None:
    """Raises if a delivery's size is further from what was announced than the tolerance."""
    if expected <= 0 or abs(actual - expected) * 100 > tolerance_pct * expected:
        raise ValueError(f"{actual} rows, {expected} announced")


def content_checksum(df: DataFrame) -> DataFrame:
    """(rows, checksum): the same for the same rows in any order and partitioning; repeated rows count."""
    row = F.xxhash64(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in sorted(df.columns)])
    parts = df.select(row.alias("h")).agg(F.count("*").alias("rows"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("a"), F.bit_xor("h").alias("b"))
    return parts.select("rows", F.sha2(F.concat_ws("|", "rows", "a", "b"), 256).alias("checksum"))
