"""Identity buckets of the registry: which NPIs share official+phone, name+phone or name+official."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bucket types and the keys they are built of.
OFFICIAL_PHONE, NAME_PHONE, NAME_OFFICIAL = "op", "np", "no"


def bucket_members(keys: DataFrame) -> DataFrame:
    """(bucket_type, bucket_key, npi) of npi_identity_keys, a row for each bucket that a row of the table falls in.

    Exactly repeated key rows are reduced first, by an aggregation that combines them before the shuffle, as later steps
    can't split equal rows. Null or empty names, officials, phones and NPIs make no bucket; a phone that stands twice in
    one array makes one.
    """
    rows = keys.select(
        F.trim("npi").alias("npi"),
        F.nullif("name_key", F.lit("")).alias("name"),
        F.nullif("official_key", F.lit("")).alias("official"),
        F.array_sort(F.array_distinct(F.filter(F.coalesce("phones", F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != "")))).alias("phones"),
    ).filter("npi is not null and npi != '' and (name is not null or official is not null)").distinct()
    join = lambda kind, *parts: F.struct(F.lit(kind).alias("t"), F.concat(*parts).alias("k"))  # noqa: E731  (null if a part is)
    bar = F.lit("|")
    buckets = F.concat(
        F.array(join(NAME_OFFICIAL, F.col("name"), bar, F.col("official"))),
        F.transform("phones", lambda p: join(OFFICIAL_PHONE, F.col("official"), bar, p)),
        F.transform("phones", lambda p: join(NAME_PHONE, F.col("name"), bar, p)),
    )
    return rows.select(F.explode(F.filter(buckets, lambda b: b["k"].isNotNull())).alias("b"), "npi").select(
        F.col("b.t").alias("bucket_type"), F.col("b.k").alias("bucket_key"), "npi"
    )
