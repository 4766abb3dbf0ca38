"""What a web page or a mail holds: addresses, numbers, links, and lines of plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of image names that look like a mail address, and tags that end a line.
IMAGES = "png|jpg|jpeg|gif|svg|webp"
LINE_TAGS = "br|/p|/div|/li|/h[1-4]|/span"


def emails(text: Column) -> Column:
    """The distinct mail addresses of a text in small letters, in order; file names of images are none. Null has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"), 1)
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda e: ~e.rlike(rf"\.({IMAGES})$")))


def phones(text: Column) -> Column:
    """The distinct phone numbers of a text as written, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})"), 1)
    return F.array_distinct(F.transform(found, lambda p: F.trim(p)))  # trim itself would take the index for characters


def links(html: Column) -> Column:
    """An array (href, text) of the anchors of a page that lead to pages; mail and phone links are left out."""
    anchors = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<a\s+[^>]*href\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a>)"), 1)
    parts = F.transform(anchors, lambda a: F.struct(F.regexp_extract(a, r"(?i)href\s*=\s*[\"']([^\"']+)", 1).alias("href"), F.trim(plain_text(a)).alias("text")))
    return F.filter(parts, lambda p: ~F.lower(p["href"]).rlike("^(mailto|tel):"))


def plain_text(html: Column) -> Column:
    """A page without tags, a line for each block."""
    lined = F.regexp_replace(html, rf"(?i)<({LINE_TAGS})\s*/?>", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(lined, "<[^>]+>", " "), "(?i)&nbsp;", " "), "(?i)&amp;", "&")


def text_lines(html: Column) -> Column:
    """The lines of a page that hold something, spaces collapsed."""
    lines = F.transform(F.split(plain_text(F.coalesce(html, F.lit(""))), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(lines, lambda x: x != "")


def people(html: Column, titles: str) -> Column:
    """An array (name, title) of a page: 'Name, title' on a line, or a title with a name on the line before.

    titles is a pattern of words that a title holds. Lines over 120 characters name nobody.
    """
    lines, name = text_lines(html), r"[A-Z][a-zA-Z.'-]+(?:\s+[A-Z][a-zA-Z.'-]+){1,3}"
    inline = rf"^({name})\s*[,\-–|]\s*(.+)$"

    def person(line: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at(lines, i))
        own = F.struct(F.regexp_extract(line, inline, 1).alias("name"), F.regexp_extract(line, inline, 2).alias("title"))
        above = F.struct(before.alias("name"), line.alias("title"))
        is_title = (F.length(line) <= 120) & line.rlike(rf"(?i)\b({titles})\b")
        return F.when(is_title & line.rlike(inline), own).when(is_title & (F.length(before) < 60) & before.rlike(rf"^{name}$"), above)

    return F.array_distinct(F.array_compact(F.transform(lines, person)))
