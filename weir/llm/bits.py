"""A semi-join filter of bounded size: which rows may have a partner, told by one bit of a hash of their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 16 for each key, from 1 to 32 MiB in all. More keys let more rows pass in vain, never fewer than needed.
LEAST, MOST, A_KEY = 1 << 23, 1 << 28, 16


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def may_have_partner(df: DataFrame, key: str, partners: DataFrame, partner_key: str, keys: int = 0) -> DataFrame:
    """The rows of df whose key may occur in partners, for a join that follows; rows that do occur always pass.

    keys is how many keys partners has at most, if known. Bitmaps are combined inside each task and then globally, and at
    most MOST / 32,768 of 4 KiB are broadcast.
    """
    bits = LEAST
    while bits < min(MOST, A_KEY * keys):
        bits *= 2
    maps = (
        partners.select(_slot(F.col(partner_key), bits).alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("__bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__bits"))
    )
    slot = _slot(F.col(key), bits)
    rows = df.withColumn("__bucket", F.bitmap_bucket_number(slot)).withColumn("__at", F.bitmap_bit_position(slot))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(__at % 8 as int))")) != 0
    return rows.join(F.broadcast(maps), "__bucket").filter(hit).drop("__bucket", "__at", "__bits")
