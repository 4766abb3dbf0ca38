"""Canonical forms under which two deliveries of a registry value count as equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_scalar(value: Column) -> Column:
    """Text of a JSON scalar: a quoted string unescaped, JSON null as null, anything else (numbers, bare text) as it stands."""
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    return F.when(value.startswith('"'), F.coalesce(quoted, value)).when(F.trim(value) != "null", value)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _phone(v: Column) -> Column:
    d = digits(F.regexp_replace(v, r"\.0+$", ""))
    ten = F.regexp_extract(d, "^1?([0-9]{10})", 1)
    return F.nullif(F.when(ten != "", ten).otherwise(d), F.lit(""))


def _postal(v: Column) -> Column:
    d = digits(F.regexp_replace(v, r"\.0+$", ""))
    return F.nullif(F.when(F.length(d).isin(4, 8), F.concat(F.lit("0"), d)).otherwise(d), F.lit(""))


def _date(v: Column) -> Column:
    part = F.split(v, "/")
    us = F.concat_ws("-", F.get(part, F.lit(2)), F.lpad(F.get(part, F.lit(0)), 2, "0"), F.lpad(F.get(part, F.lit(1)), 2, "0"))
    return F.when(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.left(v, F.lit(10))).when(v.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), us).otherwise(F.upper(v))


def _codes(v: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(F.upper(v), '[{}" ]', ""), ","), lambda c: c != "")
    return F.nullif(F.array_join(F.array_sort(parts), ","), F.lit(""))


def canonical_value(field: Column, value: Column) -> Column:
    """The form of a registry field's value that decides whether it really changed; blank and '{}' are null."""
    v = F.trim(value)
    low = F.lower(v)
    flag = F.when(low.isin("true", "t", "y", "yes", "1"), "true").when(low.isin("false", "f", "n", "no", "0"), "false").otherwise(low)
    return F.when(
        v.isNotNull() & (v != "") & (v != "{}"),
        F.when(field.rlike("phone|fax"), _phone(v))
        .when(field.rlike("postal"), _postal(v))
        .when(field.rlike("date|lastupdated"), _date(v))
        .when(field == "status", F.when(low == "a", "active").when(low == "d", "deactivated").otherwise(low))
        .when(field == "isorganization", flag)
        .when(field == "taxonomy_codes", _codes(v))
        .otherwise(F.upper(F.regexp_replace(v, r"\s+", " "))),
    )
