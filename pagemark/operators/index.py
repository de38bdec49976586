"""Pages to tokens to postings: the positional index as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import FIELD_WORD, MAX_LEN, MIN_LEN, WORD, matches


#: A document's name holds in its source only.
DOC = ["source", "doc"]


def doc_keys(df: DataFrame) -> list[str]:
    return [c for c in DOC if c in df.columns]


def page_map(pages: DataFrame) -> DataFrame:
    """(source, doc, page_no, start, end): where each page lies in its document's coordinates."""
    keys = doc_keys(pages)
    if "start" in pages.columns:  # the source knows
        return pages.select(*keys, "page_no", "start", (F.col("start") + F.length("text")).alias("end"))
    end = F.sum(F.length("text")).over(Window.partitionBy(*keys).orderBy("page_no"))
    return pages.select(*keys, "page_no", (end - F.length("text")).cast("long").alias("start"), end.cast("long").alias("end"))


def located(pages: DataFrame) -> DataFrame:
    """``pages`` with each page's start; without a shuffle where the source gives it."""
    return pages if "start" in pages.columns else pages.join(page_map(pages).drop("end"), [*doc_keys(pages), "page_no"])


def _kept(pages: DataFrame) -> list[str]:
    return [*doc_keys(pages), *[c for c in ("start",) if c in pages.columns]]


def tokens(pages: DataFrame, lengths: bool = True) -> DataFrame:
    """(source, doc, page_no, pos, word) of the body pages; within the row, so nothing is shuffled."""
    keep = _kept(pages)
    low = pages.where("page_no > 0").select(*keep, "page_no", F.lower("text").alias("low"))
    # An outer explode: for a plain one, Spark would work out the array once more as a filter.
    rows = low.select(*keep, "page_no", F.explode_outer(matches(F.col("low"), WORD)).alias("t")).select(*keep, "page_no", "t.pos", "t.word")
    return rows.where(F.length("word").between(MIN_LEN, MAX_LEN) if lengths else F.col("word").isNotNull())


def fields(pages: DataFrame) -> DataFrame:
    """(source, doc, key, value, off) of the header lines; a value ends at a second equals sign."""
    keep = _kept(pages)
    low = pages.where("page_no = 0").select(*keep, F.lower("text").alias("low"))
    lines = low.select(*keep, F.explode(matches(F.col("low"), r"[^\n]+")).alias("l")).where(F.col("l.word").contains("="))
    parts = F.split("l.word", "=")
    return lines.select(*keep, parts[0].alias("key"), parts[1].alias("value"), (F.col("l.pos") + F.length(parts[0]) + 1).alias("off")).where("length(key) >= 3")


def field_tokens(pages: DataFrame) -> DataFrame:
    """(source, doc, key, pos, word) of the words in header values."""
    keep = _kept(pages)
    return fields(pages).select(*keep, "key", "off", F.explode(matches(F.col("value"), FIELD_WORD)).alias("t")).select(*keep, "key", (F.col("off") + F.col("t.pos")).alias("pos"), F.col("t.word").alias("word"))


def vocabularies(*each: DataFrame) -> DataFrame:
    """(stem, grp, voc_no, low, high) of vocabularies ``(stem, grp)``, numbered in order.

    A vocabulary holds for words whose first letter lies between its first and last ones.
    """
    out: DataFrame | None = None
    for n, voc in enumerate(each):
        span = voc.agg(F.min(F.when(F.col("stem") >= "a", F.substring("stem", 1, 1))).alias("low"), F.max(F.substring("stem", 1, 1)).alias("high")).first()
        part = voc.select(F.col("stem").cast("string").alias("stem"), F.col("grp").cast("int").alias("grp"), F.lit(n).alias("voc_no"), F.lit(span["low"]).alias("low"), F.lit(span["high"]).alias("high"))
        out = part if out is None else out.union(part)
    return out


def group_code(grp: Column, voc_no: Column) -> Column:
    return F.concat(F.lit("#"), F.hex(F.shiftleft(voc_no.cast("int"), 24).bitwiseOR(grp.cast("int"))))


def terms(words: DataFrame, stops: list[str] = (), stems: bool = True, vocabulary: DataFrame | None = None) -> DataFrame:
    """(word, term, kind) of distinct words: surface form, and ``#group`` or else ``$stem`` if other.

    Stop words have no terms, and numbers only their form. ``vocabulary`` (see ``vocabularies``;
    a plain (stem, grp) will do) is joined on the stem; Spark broadcasts it while it is small.
    """
    distinct = words.select("word").distinct()
    if stops:
        distinct = distinct.where(~F.col("word").isin(*stops))
    coded = distinct.withColumn("stem", F.when(F.col("word").rlike("^[0-9]"), None).otherwise(stem(F.col("word"))) if stems else F.lit(None).cast("string"))
    if vocabulary is not None:
        voc = vocabulary if "voc_no" in vocabulary.columns else vocabulary.withColumns({"voc_no": F.lit(0), "low": F.lit(None).cast("string"), "high": F.lit(None).cast("string")})
        first = F.substring("word", 1, 1)
        inside = F.coalesce(first.between(F.col("low"), F.col("high")), F.lit(True)) & ~F.col("word").rlike("^[0-9]")
        coded = coded.join(voc.select(F.col("stem").alias("key"), "grp", "voc_no", "low", "high"), (F.coalesce("stem", "word") == F.col("key")) & inside, "left")
    else:
        coded = coded.withColumns({"grp": F.lit(None).cast("int"), "voc_no": F.lit(0)})
    code = lambda term, kind: F.struct(term.alias("term"), F.lit(kind).alias("kind"))
    made = F.array(
        code(F.col("word"), "form"),
        F.when((F.col("stem") != F.col("word")) & F.col("grp").isNull(), code(F.concat(F.lit("$"), "stem"), "stem")),
        F.when(F.col("grp").isNotNull(), code(group_code(F.col("grp"), F.col("voc_no")), "group")),
    )
    out = coded.select("word", F.explode(F.array_compact(made)).alias("c")).select("word", "c.term", "c.kind")
    return out if vocabulary is None else out.distinct()


def postings(pages: DataFrame, stops: list[str] = (), stems: bool = True, vocabulary: DataFrame | None = None, prepare: Callable[[Column], Column] | None = None) -> DataFrame:
    """(term, kind, source, doc, page_no, pos, coord) of body and header words, and field markers.

    ``prepare`` may rewrite a word before it is coded; null drops it.
    """
    pages = located(pages)
    keys = doc_keys(pages)
    body = tokens(pages).select(*keys, "page_no", "pos", (F.col("start") + F.col("pos")).alias("coord"), "word")
    heads = field_tokens(pages).withColumns({"page_no": F.lit(0), "coord": F.col("start") + F.col("pos")})
    words = body.union(heads.select(*keys, "page_no", "pos", "coord", "word"))
    if prepare is not None:
        words = words.withColumn("word", prepare(F.col("word"))).where("word IS NOT NULL AND word <> ''")
    if stems or vocabulary is not None:
        coded = words.join(terms(words, list(stops), stems, vocabulary), "word")
    else:  # forms are their own terms
        coded = words.where(~F.col("word").isin(*stops)) if stops else words
        coded = coded.withColumns({"term": F.col("word"), "kind": F.lit("form")})
    cols = ["term", "kind", *keys, "page_no", "pos", "coord"]
    marks = heads.withColumns({"term": F.concat(F.lit("&"), "key"), "kind": F.lit("field"), "pos": F.col("pos") - 1, "coord": F.col("coord") - 1})
    return coded.select(*cols).union(marks.select(*cols).distinct())


def dictionary(post: DataFrame) -> DataFrame:
    """(term, kind, n_postings, n_docs)."""
    return post.groupBy("term", "kind").agg(F.count(F.lit(1)).alias("n_postings"), F.count_distinct(*doc_keys(post)).alias("n_docs"))


def term_count(words: DataFrame) -> int:
    """The number of terms of a dictionary."""
    return words.select("term").distinct().count()


def max_coord(pages: DataFrame) -> int:
    """The length of all text."""
    return pages.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0


def load_stops(spark: SparkSession, path: str) -> list[str]:
    """The lines of a stop-word file but blank ones and those with a semicolon; a short list."""
    lines = spark.read.text(path).where(~F.col("value").contains(";") & (F.trim("value") != ""))
    return [r["value"] for r in lines.distinct().orderBy("value").collect()]


def save(post: DataFrame, path: str) -> None:
    """Write postings by ranges of terms, so that a search reads few row groups."""
    post.repartitionByRange("term").sortWithinPartitions("term", *doc_keys(post), "coord").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
