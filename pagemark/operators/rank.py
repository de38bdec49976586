"""Hits to pages and documents with ranks, caps, word counts and snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import doc_keys

MAX_PAGES, MAX_DOCS = 30_001, 500
HEADER_BONUS = 10
SNIPPET = 320
OPEN, CLOSE = "ˋ", "ˊ"


def page_ranks(hits: DataFrame) -> DataFrame:
    """(source, doc, page_no, n, rank, positions): 1 + sum of 30 div max(5, gap) + ln(n)."""
    page = [*doc_keys(hits), "page_no"]
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy(*page).orderBy("pos"))
    near = hits.withColumn("bonus", F.when(gap.isNull(), F.lit(0)).otherwise(F.floor(F.lit(30) / F.greatest(F.lit(5), gap))))
    pages = near.groupBy(*page).agg(F.count(F.lit(1)).alias("n"), F.sum("bonus").alias("bonus"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return pages.select(*page, "n", (1 + F.col("bonus") + F.ln("n")).alias("rank"), "positions")


def cap_pages(pages: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """The first pages by document and number."""
    return pages.orderBy(*doc_keys(pages), "page_no").limit(most)


def doc_ranks(pages: DataFrame) -> DataFrame:
    """(source, doc, n_pages, rank): 1 + ln of the sum of page ranks; tenfold if the header was hit."""
    keys = doc_keys(pages)
    docs = pages.groupBy(*keys).agg(F.count(F.when(F.col("page_no") > 0, 1)).alias("n_pages"), F.sum("rank").alias("s"), F.min("page_no").alias("first"))
    return docs.select(*keys, "n_pages", ((1 + F.ln("s")) * F.when(F.col("first") == 0, HEADER_BONUS).otherwise(1)).alias("rank"))


def top_docs(docs: DataFrame, most: int = MAX_DOCS, ascending: bool = False, compat: bool = False) -> DataFrame:
    """The best documents; ``compat`` takes the first by name and then orders them upward."""
    keys = doc_keys(docs)
    if compat:
        return docs.orderBy(*keys).limit(most).orderBy("rank", *keys)
    return docs.orderBy(F.col("rank").asc() if ascending else F.col("rank").desc(), *reversed(keys)).limit(most)


def word_info(hits: DataFrame, names: list[str]) -> DataFrame:
    """(word, n) for each word of the query: its postings among the hits."""
    bits = F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(w)) for i, w in enumerate(names)])
    return hits.select(F.explode(F.array_compact(bits)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def spans(text: str, positions: list[int]) -> list[tuple[str, bool]]:
    """The text in parts, words at ``positions`` marked; a place inside a marked word is passed."""
    out, last = [], 0
    for p in positions:
        if p < last:
            continue
        m = re.compile(r"\w+").match(text, p)
        end = m.end() if m else p
        out += [(text[last:p], False), (text[p:end], True)]
        last = end
    return [*out, (text[last:], False)]


def snippet(text: str, positions: list[int], size: int = SNIPPET) -> str:
    """A stretch around the hits with marked words, never cut, and tidied punctuation."""
    a = max(0, min(positions) - size // 4)
    b = min(max(positions) + size // 4, len(text), a + size)
    out, at = [], 0
    for part, marked in spans(text, positions):
        s, e = at, at + len(part)
        at = e
        if e <= a or s >= b:
            continue
        part = part if marked else part[max(0, a - s) : max(0, b - s)]
        for c in ".?!:,":
            part = re.sub(rf"\b\W*{re.escape(c)}+\W*\b", f"{c} ", part)
        out.append(f"{OPEN}{part}{CLOSE}" if marked else part)
    return "".join(out)


def snippets(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(source, doc, page_no, rank, positions, text, words) of ranked body pages, texts joined by page."""
    keys = doc_keys(pages)
    schema = ", ".join(f"{c} string" for c in keys) + ", page_no int, rank double, positions array<int>, text string, words array<string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [(snippet(t, list(p)), list(dict.fromkeys(w for w, m in spans(t, list(p)) if m))) for t, p in zip(f["text"], f["positions"])]
            yield f.assign(text=[m[0] for m in made], words=[m[1] for m in made])

    rows = pages.where("page_no > 0").join(texts.select(*keys, "page_no", "text"), [*keys, "page_no"])
    return rows.select(*keys, "page_no", "rank", "positions", "text", F.array().cast("array<string>").alias("words")).mapInPandas(run, schema)


def summaries(shown: DataFrame, best: int = 3, lowest: bool = False, by_id: bool = False) -> DataFrame:
    """(source, doc, summary, found_words): a few pages' snippets and all marked words.

    The snippets come in page order; ``by_id`` orders page numbers as text, as the original does.
    """
    keys = doc_keys(shown)
    order = F.col("rank").asc() if lowest else F.col("rank").desc()
    chosen = shown.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "page_no"))).where(F.col("r") <= best)
    place = F.col("page_no").cast("string") if by_id else F.col("page_no")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), "text"))), lambda x: x["text"]), " ... ")
    found = shown.select(*keys, F.explode("words").alias("w")).distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("w")).alias("found_words"))
    return chosen.groupBy(*keys).agg(text.alias("summary")).join(found, keys, "left")


def headers(pages: DataFrame) -> DataFrame:
    """(source, doc, headers): each document's header lines as a map; the first of equal keys counts."""
    keys = doc_keys(pages)
    lines = F.filter(F.split("text", "\n"), lambda x: x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))
    first = F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["k"]), x["k"]) == i + 1)
    return pages.where("page_no = 0").select(*keys, F.map_from_entries(first).alias("headers"))
