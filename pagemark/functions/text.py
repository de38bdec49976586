"""Text to tokens, pages and fields, on built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}+|\p{N}+"
FIELD_WORD = r"[\p{L}\p{N}_]+"
PAGE_CHARS = 3000
MIN_LEN, MAX_LEN = 3, 32


def matches(text: Column, pattern: str) -> Column:
    """array<struct<word, pos>> of all matches, with their offsets in code points.

    Offsets are running sums of the lengths of gaps and matches. They are gathered as one string,
    since adding to an array copies all its elements; meant for pages and lines, whose size is
    bounded.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), found, lambda g, w: F.struct(F.length(g).alias("g"), F.length(w).alias("w")))

    def step(acc: Column, x: Column) -> Column:
        at = acc["end"] + x["g"]
        return F.struct(F.concat(acc["at"], F.lit(","), at.cast("string")).alias("at"), (at + x["w"]).alias("end"))

    places = F.split(F.substring(F.aggregate(sizes, F.struct(F.lit("").alias("at"), F.lit(0).alias("end")), step, lambda acc: acc["at"]), 2, 1 << 30), ",")
    empty = F.array().cast("array<struct<word:string,pos:int>>")
    return F.when(F.size(found) == 0, empty).otherwise(F.zip_with(found, places, lambda w, p: F.struct(w.alias("word"), p.cast("int").alias("pos"))))


def cut_pages(text: Column, size: int = PAGE_CHARS) -> Column:
    """The text in stretches of ``size`` characters; an empty text is one empty page."""
    last = F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def typed_value(value: Column) -> Column:
    """'long', 'decimal' or 'string', as the value reads."""
    return F.when(value.try_cast("bigint").isNotNull(), "long").when(value.try_cast("decimal(38,10)").isNotNull(), "decimal").otherwise("string")


def numeric_entities(text: Column) -> Column:
    """``text`` with ``&#233;`` and ``&#xe9;`` as characters; numbers that are none stay."""
    pattern = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def char(x: Column) -> Column:
        code = F.when(x.rlike("^&#[xX]"), F.conv(F.regexp_extract(x, "[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(x, "([0-9]+)", 1)).cast("long")
        good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(F.lit(32).cast("long"))), 8, "0")), "UTF-32")).otherwise(x)

    parts = F.split(text, pattern, -1)
    joined = F.array_join(F.zip_with(parts, F.transform(found, char), lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    return F.when(F.size(found) > 0, joined).otherwise(text)


def html_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments or tags; images' alt texts stay."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r'(?is)<img\b[^>]*?\balt="([^"]*)"[^>]*>', " $1 ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    x = numeric_entities(x)
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    x = F.regexp_replace(x, r"[ \t\r]*\n[ \t\r\n]*", "\n")
    return F.btrim(F.regexp_replace(x, r"[ \t]+", " "), F.lit(" \n\r\t"))


def html_author(html: Column) -> Column:
    """The content of the meta tag named Author, or null."""
    tag = F.regexp_extract(html, r"""(?is)(<meta\b[^>]*\bname=["']?author\b[^>]*>)""", 1)
    value = F.btrim(F.regexp_replace(F.regexp_extract(tag, r"""(?is)\bcontent=["']([^"']*)["']""", 1), r"[\n=]", " "))
    return F.when(value != "", value)


def html_title(html: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"[\n=]", " "))


def html_links(html: Column) -> Column:
    """Targets of links without fragments, lower case, at most 1024 characters, no images."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))
    bare = F.transform(found, lambda u: F.lower(F.regexp_replace(u, "#.*$", "")))
    return F.array_distinct(F.filter(bare, lambda u: (u != "") & (F.length(u) <= 1024) & ~u.rlike(r"\.(png|jpe?g|gif|bmp|svg|ico)$")))


def posting_units(delta: Column) -> Column:
    """Number of 15-bit units that a difference of coordinates takes."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(delta)) / 15).cast("int"))
