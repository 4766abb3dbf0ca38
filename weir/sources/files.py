"""Files as they are: facts about them, cells for spreadsheets, catalogues, and paged JSON."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weir.functions.text import formula_safe


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, checksum, lines): SHA-256 and lines of each file, a last line without an end counted; for files under 2 GB. Empty files have no row.

    A file is one task, as its checksum depends on its bytes in order; larger ones have release.content_checksum.
    """
    text = F.decode("content", "iso-8859-1")
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = ends + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"), lines.alias("lines"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, fingerprint): 'nohash:name:size:mtime' of each file, without reading what it holds."""
    meta = spark.read.format("binaryFile").load(path).select("path", "length", F.unix_seconds("modificationTime").alias("at"))
    return meta.select("path", F.concat_ws(":", F.lit("nohash"), F.substring_index("path", "/", -1), "length", "at").alias("fingerprint"))


def write_cells(df: DataFrame, path: str) -> None:
    """A CSV for spreadsheets: a header, quotes doubled, CRLF, arrays joined, and no cell that would run as a formula."""
    plain = lambda f: F.array_join(F.col(f"`{f.name}`"), "; ") if f.dataType.typeName() == "array" else F.col(f"`{f.name}`").cast("string")
    df.select(*[formula_safe(plain(f)).alias(f.name) for f in df.schema]).write.option("header", True).option("escape", '"').option("lineSep", "\r\n").mode("overwrite").csv(path)


CATALOG = "dataset array<struct<title: string, distribution: array<struct<title: string, temporal: string, accessURL: string, downloadURL: string, description: string>>>>"


def newest_distribution(catalog: DataFrame, title: str) -> DataFrame:
    """(id, label, year): the newest distribution of the datasets called `title`, also 'title : date', of a catalogue (CATALOG).

    The year is the largest in its period and title; within a year one that is described as latest goes first. Only
    distributions of a data API with a UUID in their address count.
    """
    uuid = r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
    sets = catalog.select(F.explode("dataset").alias("s")).filter(F.lower(F.trim(F.substring_index("s.title", " : ", 1))) == title.lower())
    rows = sets.select(F.explode("s.distribution").alias("d")).select("d.*")
    url = F.coalesce(F.nullif("accessURL", F.lit("")), "downloadURL")
    years = F.transform(F.regexp_extract_all(F.concat_ws(" ", "temporal", "title"), F.lit(r"\b((?:19|20)\d{2})\b"), 1), lambda y: y.cast("int"))
    known = rows.filter(url.contains("/data-api/") & url.rlike(uuid)).select(
        F.regexp_extract(url, uuid, 1).alias("id"), F.coalesce("title", "temporal").alias("label"), F.coalesce(F.array_max(years), F.lit(0)).alias("year"), (F.lower(F.trim("description")) == "latest").alias("latest")
    )
    return known.orderBy(F.desc("year"), F.desc(F.coalesce("latest", F.lit(False))), "id").limit(1).select("id", "label", "year")


def reported_rows(document: Column) -> Column:
    """The largest number under any key of a JSON text that has 'row' in it; null without one."""
    found = F.regexp_extract_all(document, F.lit(r"(?i)\"[^\"]*row[^\"]*\"\s*:\s*(\d+)"), 1)
    return F.array_max(F.transform(found, lambda n: n.cast("bigint")))


class PagedJson(DataSource):
    """Rows of a paged JSON interface as text: option url with {offset} and {size}, size, tries, and total if it is known.

    With total each page is a task; without it one task reads until a page is short. Server and network errors are tried
    again, after a pause that doubles; other errors end the read.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "row_no bigint, row string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.size = options["url"], int(options.get("size", "1000"))
        self.tries, self.total = int(options.get("tries", "4")), options.get("total")
        self.pause = float(options.get("pause", "1"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(at) for at in range(0, int(self.total), self.size)] if self.total else [InputPartition(None)]

    def page(self, offset: int) -> list:
        for left in range(self.tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(self.url.format(offset=offset, size=self.size), timeout=60) as answer:  # noqa: S310
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code < 500 or not left:
                    raise
            except urllib.error.URLError:
                if not left:
                    raise
            time.sleep(self.pause * 2 ** (self.tries - 1 - left))
        return []

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        offset = partition.value or 0
        while rows := self.page(offset):
            yield from ((offset + i, json.dumps(row, sort_keys=True)) for i, row in enumerate(rows))
            offset += self.size
            if partition.value is not None or len(rows) < self.size:
                return
