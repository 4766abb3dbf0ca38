"""Keys, classes and clean forms of short free texts, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no part of a person's name, and legal forms that stand with their letters apart.
TITLES = ["dr", "mr", "mrs", "ms", "md", "jr", "sr", "ii", "iii", "owner", "ceo"]
SPACED_FORMS = ["p l l c", "l l c", "l l p", "l p", "p c"]
#: Words of a unit, as registries write them.
UNITS = "STE|SUITE|UNIT|APT|APARTMENT|RM|ROOM|FL|FLOOR|BLDG|BUILDING|DEPT|LOT|SPC"
#: Accented letters and their plain forms.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def first_matching(value: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first pattern that a value matches; null if none does."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(value.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def first_containing(value: Column, words: Mapping[str, Sequence[str]], otherwise: str, missing: str) -> Column:
    """The first label of which a word occurs in the value, any case; words may ask for spaces around them."""
    low = F.concat(F.lit(" "), F.lower(value), F.lit(" "))
    out = F.lit(otherwise)
    for label in reversed(words):
        hit = low.rlike("|".join(rf"\Q{w}\E" for w in words[label]))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", F.lit(missing)).otherwise(out)


def plain_label(value: Column) -> Column:
    """Small letters without accents and punctuation, dashes as spaces, single spaces; null is ''."""
    low = F.translate(F.lower(F.coalesce(value, F.lit(""))), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[_\-/]+", " "), "[^a-z0-9 ]", ""), r"\s+", " "))


def says_little(label: Column, junk: Sequence[str]) -> Column:
    """Whether a plain label means nothing: under three characters, digits only, one repeated character, or a word of junk."""
    return (F.length(label) < 3) | label.rlike(r"^(\d+|(.)\2+)$") | label.isin(*junk)


def settled_label(value: Column, rules: Sequence[tuple[str, str]], junk: Sequence[str]) -> Column:
    """(target, why): what a typed label should become: a known one, the default for junk (null), or its plain form."""
    plain = plain_label(value)
    known = first_matching(plain, rules)
    why = F.when(known == F.trim(value), "ok").when(known.isNotNull(), "same meaning").when(says_little(plain, junk), "meaningless").when(plain == F.trim(value), "custom").otherwise("tidy spelling")
    return F.struct(F.when(known.isNotNull(), known).when(~says_little(plain, junk), plain).alias("target"), why.alias("why"))


def tag(value: Column, most: int = 24) -> Column:
    """A tag in small letters of a fixed set of characters; null if empty or longer than `most`."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z0-9 +&'./-]", " "), r"\s+", " "))
    return F.when(F.length(t).between(1, most), t)


def owner_key(value: Column) -> Column:
    """Letters of a person's name without titles; '' if there are none."""
    letters = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^a-z\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(letters, rf"\b({'|'.join(TITLES)})\b", " "), r"\s+", " "))


def owner_state_key(owner: Column, state: Column) -> Column:
    """owner|STATE, null unless the owner has at least two words and there is a state."""
    key, code = owner_key(owner), F.upper(F.trim(state))
    return F.when(key.contains(" ") & (code != ""), F.concat_ws("|", key, code))


def display_key(value: Column, legal: Sequence[str]) -> Column:
    """Words of a company's name without legal forms, also ones whose letters stand apart."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[.'’]", ""), "[^a-z0-9]+", " "))
    for form in SPACED_FORMS:
        words = F.regexp_replace(words, rf"\b{form}\b", form.replace(" ", ""))
    return F.array_join(F.filter(F.split(words, " "), lambda w: (w != "") & ~w.isin(*legal)), " ")


def building_key(line: Column) -> Column:
    """A street line in capitals up to its unit, which stands behind white space; null if under five characters or without a digit."""
    upper = F.regexp_replace(F.upper(F.coalesce(line, F.lit(""))), "[.,]", " ")
    cut = F.regexp_replace(F.regexp_replace(upper, r"#.*$", ""), rf"\s+({UNITS})\b.*$", "")
    key = F.trim(F.regexp_replace(cut, r"\s+", " "))
    return F.when((F.length(key) >= 5) & key.rlike("[0-9]"), key)


def suite_of(line: Column) -> Column:
    """The unit of a street line as written, in capitals; '' if it names none."""
    upper = F.regexp_replace(F.upper(F.coalesce(line, F.lit(""))), "[.,]", " ")
    return F.trim(F.regexp_replace(F.regexp_extract(upper, rf"((?:#|\b(?:{UNITS})\b).*)$", 1), r"\s+", " "))


def loose_name(value: Column, drop: Sequence[str]) -> Column:
    """A name in small letters without the words of drop and without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), rf"\b({'|'.join(drop)})\b", " "), "[^a-z0-9]+", " "))


def category_name(value: Column) -> Column:
    """A description without the code word in front of its dash; 'Other' if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(value, "^[A-Za-z]+-", "")), F.lit("")), F.lit("Other"))


def code_in(code: Column, ranges: Sequence[tuple[str, int, int]]) -> Column:
    """Whether a code of one letter and four digits lies in a range (letter, low, high)."""
    letter, number = F.regexp_extract(code, r"^([A-Z])(\d{4})$", 1), F.regexp_extract(code, r"^([A-Z])(\d{4})$", 2).try_cast("int")
    out = F.lit(False)
    for prefix, low, high in ranges:
        out = out | ((letter == prefix) & number.between(low, high))
    return F.coalesce(out, F.lit(False))


def dated_id(value: Column) -> Column:
    """The ISO date in an identifier of a letter, yyyymmdd and more digits; null if there is none or it is no such date."""
    pattern = r"^[A-Z](\d{4})(\d{2})(\d{2})\d+$"
    v = F.upper(F.trim(value))
    y, m, d = (F.regexp_extract(v, pattern, i) for i in (1, 2, 3))
    fits = y.try_cast("int").between(1966, 2100) & m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
    return F.when(F.coalesce(fits, F.lit(False)), F.concat_ws("-", y, m, d))


def months_old(day: Column, today: Column) -> Column:
    """Whole months of 30.44 days between two dates; null before the first."""
    months = F.floor(F.datediff(today, day) / 30.44)
    return F.when(months >= 0, months)


def whole_number(value: Column) -> Column:
    """A number cut to a whole one; blank or bad is null."""
    return F.regexp_replace(F.trim(value), ",", "").try_cast("double").try_cast("bigint")


def number_or_zero(value: Column) -> Column:
    """A number with thousands separators; blank or bad is 0."""
    return F.coalesce(F.regexp_replace(F.trim(value), ",", "").try_cast("double"), F.lit(0.0))


def identity_key(npi: Column, name: Column, official: Column, phone: Column) -> Column:
    """group:name|official|phone where all three say something, else singleton:npi."""
    full = (F.coalesce(name, F.lit("")) != "") & (F.coalesce(official, F.lit("")) != "") & (F.coalesce(phone, F.lit("")) != "")
    return F.when(full, F.concat(F.lit("group:"), F.concat_ws("|", name, official, phone))).otherwise(F.concat(F.lit("singleton:"), npi))


def row_md5(*columns: Column) -> Column:
    """MD5 of the columns as text, told apart by |, arrays in order; a null counts as ''."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))
